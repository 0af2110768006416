"""From syntax tree to logical query: groupings resolved, rewrites applied; still no Spark job."""
