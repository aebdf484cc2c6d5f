"""The pipeline's stages, each against a plain version on its own input, then run() as a whole."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("reliquary.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import components_expected, counts_expected, plain_lower, words_of  # noqa: E402

from reliquary.llm import packing  # noqa: E402
from reliquary.llm.queries import tokenizer_path  # noqa: E402


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def quality_plain(rows):
    out = []
    for r in rows:
        c = counts_expected(r[1] or "")
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0]:
            out.append(r)
    return out


def lines_plain(rows):
    key = lambda x: plain_lower(x.strip(" \t\n\v\f\r"))
    where = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            where[key(x)].add(r[0])
    hot, seen, out = {k for k, v in where.items() if k and len(v) >= 10}, set(), []
    for r in sorted(rows):
        kept = []
        for x in (r[1] or "").split("\n"):
            if key(x) not in hot or key(x) not in seen:
                kept.append(x)
                seen.add(key(x))
        text = "\n".join(kept)
        out.append((r[0], text, *r[2:4], len(text) if text != r[1] else r[4]))
    return out


def one_plain(rows):
    return [r for r, (_, _, c) in zip(rows, components_expected(rows, 5, 80, 100), strict=True) if c == r[0]]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    plain = (quality_plain, lines_plain, one_plain)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns, name
        if i < 3:
            assert sorted(rows_of(docs)) == sorted(plain[i](before)), name
        elif i == 3:
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r[3]] += len(words_of(r[1]))
            mixed = Counter(rows_of(docs))
            assert set(mixed) <= set(before) and max(mixed.values()) <= 3
            for r, n in mixed.items():
                taken[r[3]] += n * len(words_of(r[1]))
            longest = max(len(words_of(r[1])) for r in before)
            assert all(taken[s] <= 3 * sizes[s] for s in sizes) and abs(sum(taken.values()) - sum(sizes.values())) <= longest * len(sizes)
        else:
            words = packing.WordIds(tokenizer_path())
            want = Counter((r[0], len(words.encode([r[1] or ""])[0]) // 4 + 1) for r in before)
            got = Counter()
            by = defaultdict(int)
            for r in docs.collect():
                by[r["sequence_id"]] += r["length"]
                got[r["doc_id"]] += r["length"]
            assert got == sum((Counter({d: n * k}) for (d, n), k in want.items()), Counter())
            assert max(by.values()) <= 4096 and len(by) <= -(-sum(by.values()) // 4096) + 2


def test_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() > 0
