"""Packing by vector bin packing.

Each task packs its own rows, in windows of bounded size, so nothing is shuffled:

1. A document longer than a sequence fills whole sequences first; what remains is an item with three
   demands: tokens, segments (1) and loss-bearing tokens.
2. A sequence is filled by the dot-product heuristic: of the items that still fit, it takes the one whose
   demand vector has the largest dot product with the room left (both relative to the limits).
3. The emptiest sequences are then dissolved and their items cut to fill the gaps of the others, within the
   same limits.  What is left over goes on to the next window.
4. A task's last sequence is cut at powers of two, where a sequence needs no padding.

A document without tokens of its own (null or empty text) still has its end id.  Repeated rows are
packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import crc32_of_ids, encoder

WINDOW_SEQUENCES = 1000
Piece = tuple[int, int, int]  # document, first token, length


def fill_by_dot_product(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers; every item fits a bin by itself."""
    relative = demands / limits
    order = np.argsort(-relative.sum(axis=1), kind="stable")
    relative, waiting = relative[order], np.ones(len(order), bool)
    bins: list[list[int]] = []
    left = len(order)
    while left:
        room, own = np.ones(limits.shape[0]), []
        live = np.flatnonzero(waiting)
        part = relative[live]
        while len(live):
            fits = (part <= room + 1e-12).all(axis=1)
            if not fits.any():
                break
            if not fits.all():
                live, part = live[fits], part[fits]
            best = int(np.argmax(part @ room))
            own.append(int(order[live[best]]))
            waiting[live[best]] = False
            room = room - part[best]
            left -= 1
            keep = np.ones(len(live), bool)
            keep[best] = False
            live, part = live[keep], part[keep]
        bins.append(own)
    return bins


class Packer:
    """Takes documents as token counts; gives sequences as lists of pieces."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments = tokens, segments

    def pack(self, pieces: list[Piece], share: Callable[[Piece], int], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
        """Full sequences, and the pieces of the one that isn't full (empty if ``last``: then it is cut and given too)."""
        if not pieces:
            return [], []
        demands = np.array([(p[2], 1, share(p)) for p in pieces], float)
        bins = [[pieces[i] for i in own] for own in fill_by_dot_product(demands, self.limits)]
        loose = self._fill_gaps(bins, share)
        if not last:
            return bins, loose
        return bins + self._powers(loose, share), []

    def _fill_gaps(self, bins: list[list[Piece]], share) -> list[Piece]:
        bins.sort(key=lambda own: -sum(p[2] for p in own))
        room = [self.tokens - sum(p[2] for p in own) for own in bins]
        loss = [self.limits[2] - sum(share(p) for p in own) for own in bins]
        loose: list[Piece] = []
        at = 0
        while at < len(bins):
            if room[at] == 0 or len(bins[at]) >= self.segments or loss[at] <= 0:
                at += 1
                continue
            if not loose:
                if at == len(bins) - 1:
                    loose = bins.pop()
                    room.pop(), loss.pop()
                    break
                loose = bins.pop()
                room.pop(), loss.pop()
                continue
            doc, start, length = loose.pop()
            n = min(length, room[at])
            while n > 1 and share((doc, start, n)) > loss[at]:
                n //= 2
            if share((doc, start, n)) > loss[at]:
                loose.append((doc, start, length))
                at += 1
                continue
            bins[at].append((doc, start, n))
            room[at] -= n
            loss[at] -= share((doc, start, n))
            if n < length:
                loose.append((doc, start + n, length - n))
        return loose

    def _powers(self, loose: list[Piece], share) -> list[list[Piece]]:
        out = []
        total = sum(p[2] for p in loose)
        while total:
            want = min(1 << (total.bit_length() - 1), self.tokens)
            own: list[Piece] = []
            held = loss = 0
            while held < want and len(own) < self.segments:
                doc, start, length = loose.pop()
                n = min(length, want - held)
                while n > 1 and loss + share((doc, start, n)) > self.limits[2]:
                    n //= 2
                if loss + share((doc, start, n)) > self.limits[2]:
                    loose.append((doc, start, length))
                    break
                own.append((doc, start, n))
                held += n
                loss += share((doc, start, n))
                if n < length:
                    loose.append((doc, start + n, length - n))
            if not own:
                raise ValueError("the limit on loss-bearing tokens leaves no room for a token")
            out.append(own)
            total -= held
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 4096,
    max_segments: int = 4096,
    max_loss: int = 4096,
    prompt_col: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, loss_tokens, ids].

    Tokens of ``prompt_col`` (a prompt put before the text) bear no loss; without it all tokens do.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", loss_tokens long, ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(max_tokens, max_segments, max_loss)
        next_id = TaskContext.get().partitionId() << 32
        docs_held: dict[int, tuple[int | None, np.ndarray, int]] = {}
        waiting: list[Piece] = []
        held = 0
        count = 0

        def share(p: Piece) -> int:
            prompt = docs_held[p[0]][2]
            return max(0, p[1] + p[2] - max(p[1], prompt))

        def give(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal next_id
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            extra: dict[str, list] = {"loss_tokens": [], "ids": []}
            for own in sequences:
                offset = 0
                for p in own:
                    key, ids, _ = docs_held[p[0]]
                    part = ids[p[1] : p[1] + p[2]]
                    for name, v in zip(cols, (key, p[1], p[2], crc32_of_ids(part), len(ids), next_id, offset)):
                        cols[name].append(v)
                    if with_ids:
                        extra["loss_tokens"].append(share(p))
                        extra["ids"].append(part.astype(np.int32))
                    offset += p[2]
                next_id += 1
            arrays = {k: pa.array(v, pa.int64()) for k, v in cols.items()}
            if with_ids:
                arrays |= {"loss_tokens": pa.array(extra["loss_tokens"], pa.int64()), "ids": pa.array(extra["ids"], pa.list_(pa.int32()))}
            return pa.RecordBatch.from_pydict(arrays)

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal waiting, held, docs_held
            sequences, waiting = packer.pack(waiting, share, last)
            out = give(sequences)
            docs_held = {p[0]: docs_held[p[0]] for p in waiting}
            held = sum(p[2] for p in waiting)
            return out

        for batch in batches:
            whole: list[list[Piece]] = []
            prompts = batch.column(2).to_pylist()
            for key, text, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), prompts):
                head = enc.ids(prompt) if prompt else np.empty(0, enc.dtype)
                ids = np.concatenate([head, enc.ids(text, end_id)]) if len(head) else enc.ids(text, end_id)
                docs_held[count] = (key, ids, len(head))
                start = 0
                step = min(max_tokens, max_loss) if max_loss < max_tokens else max_tokens
                while len(ids) - start >= step:
                    if step == max_tokens:
                        whole.append([(count, start, step)])
                    else:
                        waiting.append((count, start, step))
                        held += step
                    start += step
                if len(ids) > start:
                    waiting.append((count, start, len(ids) - start))
                    held += len(ids) - start
                count += 1
                if held >= WINDOW_SEQUENCES * max_tokens or len(whole) >= WINDOW_SEQUENCES:
                    if whole:
                        yield give(whole)
                        whole = []
                    yield settle(False)
            if whole:
                yield give(whole)
                live = {p[0] for p in waiting}
                docs_held = {k: v for k, v in docs_held.items() if k in live}
        if waiting:
            yield settle(True)

    prompt = F.lit(None).cast("string") if prompt_col is None else F.col(prompt_col)
    columns = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), prompt.alias("p"))
    return columns.mapInArrow(run, schema)
