"""Small tables and plain re-computations the tests compare with."""

from __future__ import annotations

from pathlib import Path

DATA = "/root/testdata/sf0.001"
DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="src0", start=0):
    rows = [(start + i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_TYPE).repartition(3)


def folder(tmp_path: Path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
