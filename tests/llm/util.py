import duckdb

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    return duckdb.sql(f"select * from read_parquet('{SF}/documents.parquet')").df()


def closure(nodes, pairs):
    """Component by node, the smallest member, by plain search."""
    near = {n: [] for n in nodes}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out
