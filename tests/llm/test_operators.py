"""Each operator against a plain version of its contract, on texts with every awkward case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

llm = pytest.importorskip("reliquary.llm")
from pyspark.sql import functions as F  # noqa: E402

from reliquary.llm import exact_dedup, jaccard, licenses, line_dedup, mixing, packing, ppm, quality, sharding, url_filter  # noqa: E402
from reliquary.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, th long, data string, keep string, size string, key string, node string"
WORDS = [bytes(p).decode() for p in itertools.islice(itertools.permutations(b"etaoin", 4), 90)]


def plain_lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def make_rows():
    rng = random.Random(5)
    text = lambda n: "\n".join(" ".join(rng.choices(WORDS, k=rng.randrange(4, 12))) for _ in range(n))
    texts = [None, "", " ", "\n\n", "A", "a", "É é", "é É", "word", "one two three", "ONE two THREE", "Größe ÄÖÜ", "ı İ K", "x" * 5000, "#*$ a b\n#*$ a b\n" * 40]
    base = text(30)
    for k in range(12):  # near copies, and lines that all share
        w = base.split(" ")
        w[10 * k] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [base] * 5 + [base.upper()]
    texts += [text(rng.randrange(1, 9)) + "\n  Shared LINE \t\n" + text(2) for _ in range(25)] + [text(400)]
    rows = [(i if i % 17 != 3 else None, t, "en", (None, "b", "a", "ä", "z")[i % 5] if i % 3 else "hot", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[20]] * 2 + [(40, "another text of a repeated id", None, "hot", None)] + [(None, None, None, None, None)] * 2
    return [r + ("clash", 7, "clash", "clash", "clash", "clash", "clash") for r in rows]


ROWS = make_rows()
KEYED = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def lines_expected(rows, least, keep_first):
    ident = {(r[0], r[1] or "") for r in rows}
    where = defaultdict(set)
    key = lambda x: plain_lower(x.strip(" \t\n\v\f\r"))
    for d, t in ident:
        for i, x in enumerate(t.split("\n")):
            if key(x):
                where[key(x)].add(((-1 if d is None else d), zlib.crc32(b""), d, t, i))
    hot = {k for k, v in where.items() if len({(x[2], x[3]) for x in v}) >= least}
    out = {}
    for d, t in ident:
        out[d, t] = [key(x) not in hot for x in t.split("\n")]
    if keep_first:
        for k in hot:
            first = min(x[0] for x in where[k])
            return_to = [x for x in where[k] if x[0] == first]
            if len({x[3] for x in return_to}) == 1:
                _, _, d, t, i = min(return_to, key=lambda x: x[4])
                out[d, t][i] = True
            else:
                out.setdefault("open", set()).add(k)
    return out


def test_line_digests(docs, empty):
    for least in (2, 10):
        keep = lines_expected(ROWS, least, False)
        want = []
        for r in ROWS:
            lines, k = (r[1] or "").split("\n"), keep[r[0], r[1] or ""]
            kept = "\n".join(x for x, y in zip(lines, k, strict=True) if y)
            want.append((r[0], len(lines), k.count(False), hashlib.sha256(kept.encode()).hexdigest()))
        assert found(line_dedup.line_digests(docs, min_docs=least), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert line_dedup.line_digests(empty).count() == 0


def test_lines_first_stays(spark, docs, empty):
    rows = [(i, f"head {i}\nshared\nshared\n tail") + (None,) * 10 for i in range(40)] + [(50, None) + (None,) * 10]
    made = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(7), min_docs=10, keep_first=True).collect()}
    assert made[0]["text"] == "head 0\nshared\n tail" and all(made[i]["text"] == f"head {i}" and made[i]["n_chars"] == len(f"head {i}") for i in range(1, 40))
    assert made[50]["text"] is None
    again = line_dedup.dedup_lines(docs, min_docs=2, keep_first=True)
    assert again.columns == docs.columns and again.count() == len(ROWS) and again.where("doc = 'clash' and keep = 'clash'").count() == len(ROWS)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_over_partition_edges():
    """Streams in pieces, cut anywhere, give what one stream gives."""
    import pyarrow as pa

    class Context:
        def __init__(self, n):
            self.n = n

        def partitionId(self):
            return self.n

    rng = random.Random(2)
    # Positions differ by line, so that a dropped (document, position) tells which row it was.
    rows = sorted({(h, 0, rng.randrange(30 if h < 5 else 12), 0, 10 * h + rng.randrange(3)) for h in [rng.randrange(8) for _ in range(260)]})
    want = {r for r in rows if len({x[2] for x in rows if x[0] == r[0]}) >= 10}
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int32() if i == 4 else pa.int64()) for i in range(5)], ["h1", "h2", "doc", "th", "pos"])
    old = line_dedup.TaskContext
    for trial in range(40):
        first = trial % 2 == 1
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), rng.randrange(0, 6))), len(rows)]  # also within a document's rows
        drop, wait, sums, ends = set(), [], [], {}
        for n, (a, z) in enumerate(itertools.pairwise(cuts)):
            class Fixed:
                get = staticmethod(lambda n=n: Context(n))

            line_dedup.TaskContext = Fixed
            part, at = rows[a:z], 0
            parts = []
            while at < len(part):
                step = rng.randrange(1, 60)
                parts.append(batch(part[at : at + step]))
                at += step
            for out in line_dedup._stream(10, first)(iter(parts)):
                for r in out.to_pylist():
                    if r["kind"] == 0:
                        drop.add((r["doc"], r["pos"], None))
                    elif r["kind"] in (3, 4):
                        sums.append(r)
                        ends[r["h1"], r["part"], r["kind"]] = r["doc"], r["th"]
                    else:
                        wait.append(r)
        total, lead = Counter(), {}
        for r in sums:
            total[r["h1"]] += r["n"]
            lead[r["h1"]] = min(lead.get(r["h1"], 99), r["part"])
        for h in total:
            parts = sorted(p for x, p, kind in ends if x == h and kind == 3)
            total[h] -= sum(ends[h, a, 4] == ends[h, b, 3] for a, b in itertools.pairwise(parts))
        got = [(d, p) for d, p, _ in drop] + [(r["doc"], r["pos"]) for r in wait if total[r["h1"]] >= 10 and not (first and r["kind"] == 2 and r["part"] == lead[r["h1"]])]
        expected = {(r[2], r[4]) for r in want}
        if first:
            expected = {(r[2], r[4]) for r in want - {min(x for x in want if x[0] == h) for h in {x[0] for x in want}}}
        assert set(got) == expected and len(got) == len(want) - first * len({x[0] for x in want})
    line_dedup.TaskContext = old


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=4).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_balances_mixed_sizes(spark):
    """Short and very long texts, one key that repeats, rows that repeat an id: sizes stay near equal, reruns agree."""
    rng = random.Random(12)
    rows = [(i, "w" * int(rng.paretovariate(1.1) * 40)) if i % 4 else (7, "same text") for i in range(4000)]
    rows = [(i, t[:20_000] + str(i)) if i != 7 else (i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shards in (2, 8):
        out = sharding.shard_documents(docs, shards=shards).collect()
        sizes = Counter()
        for r in out:
            sizes[r["shard"]] += r["size"]
        share, largest = sum(sizes.values()) / shards, max(len(t) for _, t in rows) + 1
        assert len(out) == len(rows) and set(sizes) == set(range(shards))
        assert max(sizes.values()) - min(sizes.values()) <= max(0.03 * share, largest), sizes
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_splits_a_text_that_outweighs_a_shard(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = {r["shard"]: r["b"] for r in sharding.shard_documents(rows).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * sum(sizes.values()) / 8


def test_packing(docs, empty):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, size=64).collect()
    tokenizer, want = packing.WordIds(path).tokenizer, Counter()
    for r in ROWS:  # the library's own ids of the whole text
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for p, s in enumerate(range(0, len(ids) // 4, 64)):
            want[r[0], p, s, min(64, len(ids) // 4 - s), zlib.crc32(ids[4 * s : 4 * s + 256])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 64
    assert len(by) <= packing.lower_bound(np.array([r["length"] for r in rows]), 64) * 1.05 + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_exchanges_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 60)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, "a " * rng.choice([19, 24, 32, 39, 44])) for i in range(400)], "doc_id long, text string")
    out = packing.pack_documents(rows, path, size=64).collect()
    lengths = np.array([r["length"] for r in out])
    assert len(out) == 400 and len({r["sequence_id"] for r in out}) <= packing.best_fit_decreasing(lengths, 64)[2] + 3


def test_lm_scores(docs, empty, monkeypatch):
    order = 3
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    model, counts, learned = ppm.AdaptiveTrie(order), Counter(), 0
    for r in ROWS:
        if not held(r[0]):
            data = plain_lower(r[1] or "").encode()
            padded = b"\0" * order + data
            for i, s in enumerate([*data, ppm.END]):
                model.learn(padded[i : i + order], s)
            counts.update(words_of(plain_lower(r[1] or "")))
            learned += 1
    total, kinds = sum(counts.values()) + learned, len(counts) + 1
    want = []
    for r in ROWS:
        words = words_of(plain_lower(r[1] or ""))
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words) + math.log10((learned + 1) / (total + kinds + 1))
        want.append((r[0], held(r[0]), len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total, round(base, 4), round(model.read((r[1] or "").encode(), False), 2)))
    for block, chunk in ((1_000_000, 16 << 20), (60, 2000)):  # in one block and chunk; in many, with suffixes that are cut further
        monkeypatch.setattr(ppm, "BLOCK", block)
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        got = [(*r[:5], round(r[5], 4), round(r[6], 2)) for r in ppm.score_documents(docs, order).collect()]
        got, expected = sorted(got, key=repr), sorted(want, key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in expected]
        assert all(abs(g[5] - w[5]) < 1e-3 and abs(g[6] - w[6]) < 0.02 + 1e-5 * abs(w[6]) for g, w in zip(got, expected, strict=True))
    assert ppm.score_documents(empty).count() == 0


def test_lm_trie_in_blocks(monkeypatch):
    """A trie cut into blocks, hot suffixes further than others, answers as the whole one does."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abe ", (1, 1, 6, 6), k=300)).encode() for _ in range(20)]
    for order in (3, 4, 5):
        grams = np.concatenate([x.grams for _, x in ppm.blocks(texts, order)])
        keys, counts = ppm._counted(grams)
        low = ppm._merged([keys & ((1 << 17) - 1)], [counts])
        whole = ppm.Trie(order, keys, counts, {1: low})
        asked = np.unique(np.concatenate([grams, *(x.grams for _, x in ppm.blocks([b"babe eee bbb", b"unseen \xc3\xa9 zz"], order))]))
        want, crowded, levels, within = whole.score(asked), {}, {1: low}, np.ones(len(keys), bool)
        for m in range(2, order):
            suffixes, n = np.unique(ppm._suffix(keys[within], m), return_counts=True)
            if not (n > 12).any():
                break
            crowded[m] = suffixes[n > 12]
            within &= np.isin(ppm._suffix(keys, m), crowded[m])
            levels[m] = ppm._merged([keys[within] & ((1 << (8 * m + 9)) - 1)], [counts[within]])
        assert len(crowded) == order - 2
        for n in (1, 5, 40):
            block, home = ppm._block_of(asked, crowded, n), ppm._block_of(keys, crowded, n)
            for b in range(n):
                part = ppm.Trie(order, keys[home == b], counts[home == b], levels)
                assert np.allclose(part.score(asked[block == b]), want[block == b], atol=1e-5), (order, n, b)


def test_lm_is_a_distribution_and_adapts(spark):
    trie = ppm.AdaptiveTrie(2)
    trie.read(b"abracadabra")
    assert abs(sum(trie.probability(b"ra", s) for s in range(257)) - 1) < 1e-9
    rows = ppm.adaptive_scores(spark.createDataFrame([(1, "ab" * 200), (2, None)], "doc_id long, text string")).collect()
    assert rows[0]["score"] > -120 and rows[1]["score"] == pytest.approx(-math.log10(257))


def test_exact_duplicates(docs, empty):
    for keep, pick in (("max", max), ("min", min)):
        groups = defaultdict(list)
        for r in ROWS:
            groups[plain_lower(r[1] or "")].append(r[0])
        want = []
        for r in ROWS:
            t = plain_lower(r[1] or "")
            ids = [d for d in groups[t] if d is not None]
            best = pick(ids) if ids else None
            want.append((r[0], best, len(groups[t]), r[0] == best, hashlib.sha256(t.encode()).hexdigest()))
        assert found(exact_dedup.exact_duplicates(docs, keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_digest_index_merges_runs(spark):
    index = exact_dedup.DigestIndex("min")
    for at in (5, 0):
        index.flush(spark.createDataFrame([(at + i, f"t{i}") for i in range(5)], "doc_id long, text string"))
    rows = index.compact().collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == [(i, 2) for i in range(5)]
    assert index.n_runs == 2 * exact_dedup.RUNS and {r["run"] for r in index.filters().collect()} <= set(range(index.n_runs))
    assert index.lookup([hashlib.sha256(b"t3").digest()]).first()["keep_id"] == 3


def test_digest_filters_miss_nothing(spark, monkeypatch):
    """A digest that several runs have is never taken for settled, and few others are merged; also where filters are joined by shuffle."""
    rows = spark.createDataFrame([(i, f"text {i if i % 5 else i // 2}") for i in range(2000)], "doc_id long, text string")
    for most in (exact_dedup.FILTER_BYTES, 0):
        monkeypatch.setattr(exact_dedup, "FILTER_BYTES", most)
        index = exact_dedup.DigestIndex("min")
        index.flush(rows)
        probed = index._may_be_elsewhere().collect()
        runs = Counter(bytes(r["digest"]) for r in probed)
        assert all(r["elsewhere"] for r in probed if runs[bytes(r["digest"])] > 1) and max(runs.values()) > 1
        assert sum(r["elsewhere"] for r in probed if runs[bytes(r["digest"])] == 1) < 0.3 * len(probed)


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(words_of(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:  # reshare the excess until none is above
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    taken, longest = defaultdict(int), defaultdict(int)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r[0] or -1, len(words_of(r[1] or ""))) for r in ROWS)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in names)
    assert found(mixing.mix_sources(docs), "doc_id", "source", "size", "taken") == found(mixing.mix_sources(docs.repartition(3)), "doc_id", "source", "size", "taken")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(len(words_of(r["text"] or "")) for r in mixed.collect()) == Counter(k for r in rows for k in [r["size"]] * r["copies"])
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def counts_expected(t):
    w = words_of(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge_quality(docs, labels).collect()
    want = []
    for r in ROWS:
        c = counts_expected(r[1] or "")
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((r[0], *c, failed, not failed))
    assert sorted(((r["doc_id"], *[r[c] for c in quality.COUNTS[:5]], r["base_failed"], r["kept"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert quality.judge_quality(empty, labels).count() == 0
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)


def test_quality_fitted_in_spark(spark):
    """Enough labels of both classes: every score is the trees' own, walked node by node, and bad documents go."""
    rng = random.Random(11)
    good = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(60, 200))) + ".\n" + " ".join(rng.choices(WORDS, k=30))
    bad = lambda: " ".join(w + rng.choice("#$%|*") for w in rng.choices(WORDS, k=rng.randrange(60, 200)))
    rows = [(i, good() if i % 3 else bad()) for i in range(360)]
    docs = spark.createDataFrame(rows + [rows[0]] * 2, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    counts = quality.document_counts(docs)
    model, least = quality.train(counts, labels)
    again = quality.train(counts, labels)
    assert least == again[1] and (model.value == again[0].value).all()
    judged = quality.judge_quality(docs, labels).collect()
    assert len(judged) == len(rows) + 2
    for r in judged:
        x = quality.features({c: [r[c]] for c in quality.COUNTS})[0]
        total = model.base
        for n in model.roots:
            while model.left[n] != n:
                n = model.left[n] if x[model.feature[n]] <= model.cut[n] else model.right[n]
            total += model.value[n]
        assert r["score"] == pytest.approx(total) and r["kept"] == (not r["base_failed"] and r["score"] >= least)
    unseen = [r for r in judged if r["doc_id"] >= 300]
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in unseen) and len(unseen) == 60
    assert quality.keep_quality(docs, labels).where("doc_id % 3 = 0").count() == 0


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 11))
    y = ((x[:, 2] < 0.6) & (x[:, 0] > 0.3)).astype(float)
    flip = rng.random(2000) < 0.05
    y[flip] = 1 - y[flip]
    monotone = np.array(list(quality.FEATURES.values()))
    model = quality.BoostedTrees(trees=30).fit(x[:1500], y[:1500], monotone)
    assert ((model.predict(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.9
    for f in np.flatnonzero(monotone == -1):
        a, b = x[:300].copy(), x[:300].copy()
        b[:, f] += 0.3
        assert (model.predict(b) <= model.predict(a) + 1e-12).all()
    one = model.predict(x[:1])[0]  # node by node
    total = model.base
    for n in model.roots:
        while model.left[n] != n:
            n = model.left[n] if x[0, model.feature[n]] <= model.cut[n] else model.right[n]
        total += model.value[n]
    assert one == pytest.approx(total)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_licenses(spark, docs, empty):
    rng = random.Random(8)
    name, template = "GPL-3.0", licenses.TEMPLATES["GPL-3.0"]
    noise = lambda n: " ".join(rng.choices(["the", "license", "work", "of", "ether", "version", "tea"], k=n))
    cut = template.split(" ")
    del cut[3]
    texts = [f"{noise(300)} {template.upper()} {noise(90)}", f"{noise(50)}\n{' '.join(cut)}", noise(400), None, "", "All rights reserved."]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["license"] == name and rows[0]["coverage"] == 1 and rows[0]["first_word"] <= 300 <= rows[0]["last_word"]
    assert rows[1]["license"] == name and rows[1]["coverage"] >= 0.9
    assert [rows[i]["n_licenses"] for i in (2, 3, 4)] == [0, 0, 0] and rows[5]["license"] == "All-rights-reserved"
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(empty).count() == 0
    for _ in range(200):  # an alignment is a common subsequence; equal words at unique places are all found
        a, b = rng.choices("abcdefg", k=rng.randrange(12)), rng.choices("abcdefgh", k=rng.randrange(12))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs)) and [j for _, j in pairs] == sorted({j for _, j in pairs})
        assert len(pairs) <= lcs(a, b)
    assert licenses.align(list("abc"), list("xaybzc")) == [(0, 1), (1, 3), (2, 5)]


def test_licenses_found_equal_a_search_of_every_stretch(spark):
    """Against a longest common subsequence with every stretch of twice a template's length: templates cut up, words put in, repeated, or too few."""
    rng = random.Random(21)
    templates = {"A": "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10", "B": "b1 b2 b3 b4 b5", "C": "c1 c2 c3 c2 c4 c1 c5 c6 c7 c8 c9 c10"}
    texts = []
    for _ in range(150):
        words = [f"n{rng.randrange(9)}" for _ in range(rng.randrange(3, 25))]
        for t in rng.sample(sorted(templates), rng.randrange(0, 3)):
            part = templates[t].split()
            for _ in range(rng.randrange(0, 4)):
                part.pop(rng.randrange(len(part)))
            for _ in range(rng.randrange(0, 3)):
                part.insert(rng.randrange(len(part) + 1), f"n{rng.randrange(9)}")
            at = rng.choice([0, len(words)])
            words[at:at] = part
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {x["license"] for x in r["found"]} for r in licenses.scan_licenses(rows, templates).collect()}
    hits = 0
    for i, text in enumerate(texts):
        words = text.split()
        want = set()
        for name, t in templates.items():
            t = t.split()
            if any(lcs(words[a : a + 2 * len(t)], t) >= math.ceil(0.8 * len(t)) for a in range(len(words))):
                want.add(name)
        hits += len(want)
        assert got[i] == want, text
    assert hits > 60


def test_licenses_of_genuine_notices(spark):
    """Notices and texts as they stand in files, none of them in the generated documents."""
    gpl2 = """/* This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version. */"""
    gpl3 = gpl2.replace("software;", "software:").replace("Foundation;", "Foundation,").replace("version 2", "version 3")
    lgpl = gpl2.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")
    by_sa = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    mit, bsd, whole = ("Copyright (c) 1991 A. Body\n\n" + licenses.TEMPLATES[f"{n}#text"] for n in ("MIT", "BSD-3-Clause", "GPL-3.0"))
    other = bsd.replace("copyright holder", "University").replace("COPYRIGHT HOLDERS", "REGENTS")
    edited = whole.split()
    del edited[700:1000], edited[3000:3200]
    apache = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
    texts = [gpl3, gpl2, lgpl, by_sa, mit, other, whole, " ".join(edited), f"{by_sa} {gpl3}\n{gpl3}\n{mit}\n{mit}\n tea {mit}\n{by_sa}", apache, f"{whole}\n{mit}\n{whole}"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    names = {i: sorted({(x["license"], x["template"]) for x in r["found"]}) for i, r in got.items()}
    assert [got[i]["license"] for i in range(5)] == ["GPL-3.0", "GPL-2.0", "LGPL-2.1", "CC-BY-SA-4.0", "MIT"] and all(got[i]["n_licenses"] == 1 for i in range(5))
    assert names[4] == [("MIT", "text")] and ("BSD-3-Clause", "text") in names[5] and names[6] == names[7] == [("GPL-3.0", "text")]
    assert got[6]["coverage"] == 1 and got[6]["matched"] > 5000 and 0.8 <= got[7]["coverage"] < 0.95
    assert Counter(x["license"] for x in got[8]["found"]) == {"CC-BY-SA-4.0": 2, "GPL-3.0": 2, "MIT": 3} and got[8]["n_licenses"] == 3
    assert got[9]["license"] == "Apache-2.0" and [x["matched"] > 5000 for x in got[10]["found"]].count(True) == 2 and Counter(x["license"] for x in got[10]["found"])["MIT"] == 1
    for r in got.values():
        spans = sorted((x["first_word"], x["last_word"]) for x in r["found"])
        assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))


def sets_of(rows, width):
    out = []
    for r in rows:
        w = words_of(plain_lower(r[1] or ""))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def components_expected(rows, width, num, den):
    sets, at = sets_of(rows, width), list(range(len(rows)))
    def root(i):
        while at[i] != i:
            i = at[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            at[root(i)] = root(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            members[root(i)].append(r[0])
    return [(r[0], len(sets[i]), (min(members[root(i)], default=None) if sets[i] else r[0])) for i, r in enumerate(rows)]


def test_jaccard(docs, empty):
    for width, num in ((4, 85), (5, 80)):
        want = components_expected(ROWS, width, num, 100)
        assert found(jaccard.similar_documents(docs, width, num, 100), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert jaccard.similar_documents(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 16").count() == 0 and kept.where("doc_id = 15").count() == 1


def test_jaccard_lists_every_link(spark, docs, empty, monkeypatch):
    """All verified pairs of different sets and each row's number of links, also if buckets are cut into blocks."""
    for width, num, block in ((4, 85, 500), (5, 80, 4)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        sets, ids = sets_of(ROWS, width), defaultdict(set)
        alike = lambda x, y: x and y and 100 * len(x & y) >= num * len(x | y)
        for r, x in zip(ROWS, sets, strict=True):
            ids[frozenset(x)].add(r[0])
        first = {x: min((i for i in d if i is not None), default=None) for x, d in ids.items()}
        pairs = sorted((sorted((first[x], first[y]), key=repr) for x, y in itertools.combinations(ids, 2) if alike(x, y)), key=repr)
        comp = components_expected(ROWS, width, num, 100)
        want = [(*c, first[frozenset(x)] if x else c[0], sum(bool(alike(x, y)) for y in sets) - bool(x)) for c, x in zip(comp, sets, strict=True)]
        links, members = jaccard.similar_links(docs, width, num, 100)
        assert sorted((sorted(r, key=repr) for r in links.select("doc_a", "doc_b").collect()), key=repr) == pairs and len(pairs) > 40
        assert links.where("set_a >= set_b").count() == 0
        assert found(members, "doc_id", "n_shingles", "component_id", "set_id", "n_links") == sorted(want, key=repr)
    assert [x.count() for x in jaccard.similar_links(empty)] == [0, 0]


def test_jaccard_links_tell_chains_from_groups(spark):
    """Of a chain each document links with its neighbours only, of a tight group with all; both are one component."""
    w = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(w[12 * i : 12 * i + 200])) for i in range(12)] + [(100 + i, " ".join(["group"] * 2 + [f"g{j}" for j in range(200)] + [f"end{i}"])) for i in range(12)]
    got = {r["doc_id"]: r for r in jaccard.similar_links(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)[1].collect()}
    assert {got[i]["component_id"] for i in range(12)} == {0} and [got[i]["n_links"] for i in range(12)] == [1] + [2] * 10 + [1]
    assert {got[100 + i]["component_id"] for i in range(12)} == {100} and {got[100 + i]["n_links"] for i in range(12)} == {11}


def test_jaccard_finds_chains_of_edits(spark, monkeypatch):
    """Documents that drift: only neighbours link, and groups hold several components."""
    rng = random.Random(9)
    w = rng.choices(WORDS, k=220)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
    rows += [(100 + i, " ".join(rng.choices(WORDS[:3], k=rng.randrange(1, 9)))) for i in range(60)]
    rng.shuffle(rows)
    want = components_expected(rows, 4, 85, 100)
    for block, held in ((500, 1 << 20), (7, 3)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "HELD", held)
        got = found(jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4, 85, 100), "doc_id", "n_shingles", "component_id")
        assert got == sorted(want, key=repr)


def test_jaccard_groups_of_streamed_buckets(monkeypatch):
    """Whatever the batches and however many rows are held, nodes of a bucket share a group, and lone ones have none."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(40), rng.randrange(60)) for _ in range(200)) + [(50, 7)] * 30 + [(51, 9)] * 30 + [(51, 4)]
    nodes = defaultdict(set)
    for sig, node in rows:
        nodes[sig].add(node)
    for held, step in ((1 << 20, 7), (5, 3), (1, 1), (2, 300)):
        monkeypatch.setattr(jaccard, "HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + step], strict=True)], ["sig", "node"]) for i in range(0, len(rows), step)]
        groups = defaultdict(set)
        for b in jaccard._groups(batches):
            for node, pivot in zip(b["node"].to_pylist(), b["pivot"].to_pylist(), strict=True):
                groups[pivot].add(node)
        for sig, x in nodes.items():
            assert len(x) < 2 or any(x <= g for g in groups.values()), (held, sig)
        assert all(len(g) > 1 for g in groups.values())


def test_jaccard_deals_a_node_once_to_each_of_its_groups(spark, monkeypatch):
    """However many blocks a group is cut into: what two blocks need to meet is a row for each, not for each of their nodes."""
    w = [f"word{i}" for i in range(150)]
    rows = [(i, " ".join([*w[:i], f"new{i}", *w[i + 1 :]])) for i in range(150)]
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    _, _, _, meetings, scratch = jaccard._prepared(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    groups = {r["pivot"]: r["n"] for r in scratch[0].select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    assert max(groups.values()) > 100 and len(meetings) == 2
    blocks = [-(-n // 10) for n in groups.values()]
    assert meetings[0][0].count() == sum(groups.values()) and meetings[1][0].count() <= sum(b * (b - 1) for b in blocks)
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 149)}


def test_jaccard_links_within_and_across_blocks(monkeypatch):
    """Each pair of similar sets without a smaller group in common, whatever most sets of a block have."""
    rng = random.Random(12)
    for often, shared in ((0, 0.9), (32, 0.9), (1 << 40, 0.6), (2, 0.0)):
        monkeypatch.setattr(jaccard, "OFTEN", often)
        for sizes in ((40, 30), (1, 1), (2, 25), (70, 1)):
            bases, nodes = [rng.sample(range(500), 60), rng.sample(range(500), 60)], []
            bases[1] = bases[0][:55] + bases[1][:5]
            for which, size in enumerate(sizes):
                for _ in range(size):
                    elements = {x if rng.random() < max(shared, rng.random()) else rng.randrange(900) for x in bases[which]}
                    nodes.append((len(nodes), len(elements), rng.randrange(1, 4), sorted(rng.sample(range(-60, 60), 3)) + [100], sorted(elements)))
            table = lambda part: pa.Table.from_pylist([dict(zip(("pivot", "node", "n", "copies", "pivots", "set"), (5, *r), strict=True)) for r in part])
            left, right = nodes[: sizes[0]], nodes[sizes[0] :]
            alike = lambda a, b: 100 * len({*a[4]} & {*b[4]}) >= 70 * len({*a[4]} | {*b[4]}) and not any(p < 5 for p in {*a[3]} & {*b[3]})
            got = [(x, y) for x, to in jaccard._Block.of(table(left)).links(None, 70, 100) for y in to.tolist()]
            assert sorted(got) == [(x, y) for x, y in itertools.combinations(range(len(left)), 2) if alike(left[x], left[y])]
            got = [(x, y) for x, to in jaccard._Block.of(table(left)).links(jaccard._Block.of(table(right)), 70, 100) for y in to.tolist()]
            assert sorted(got) == [(x, y) for x in range(len(left)) for y in range(len(right)) if alike(left[x], right[y])]
            assert sizes != (40, 30) or shared < 0.9 or len(got) > 50


def test_jaccard_long_texts_and_words(monkeypatch):
    """Words and texts of more bytes than are hashed at once."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("aBcé", k=rng.choice([1, 3, 70, 200, 5000]))) for _ in range(300))
    want = jaccard.shingles(text.encode(), 4).tolist()
    words = words_of(plain_lower(text))
    assert len(want) == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)}) == len(set(want))
    texts = pa.array([b"", text.encode(), b"one", text.encode() + b" ", b"a b c d"], pa.binary())
    for chunk in (64, 1000, 1 << 19):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        got, at = [], 0
        for _, _, h, sizes in jaccard._sets_of(texts, 4, 0):
            for n in sizes.tolist():
                got.append(h[at : at + n].tolist())
                at += n
            at = 0
        assert got[1] == got[3] == want and [len(x) for x in got] == [0, len(want), 1, len(want), 1]
    assert jaccard.shingles(b"x" * 64, 1) != jaccard.shingles(b"x" * 128, 1) and jaccard.shingles(b"xy", 1) != jaccard.shingles(b"yx", 1)


def test_part_enum_misses_no_similar_pair():
    rng = random.Random(6)
    for num in (80, 85, 95):
        method = jaccard.PartEnum(num, 100)
        for _ in range(400):
            n = rng.choice([1, 2, 5, 7, 12, 30, 90, 250])
            base = rng.sample(range(1 << 60), 2 * n)
            x, y = set(base[:n]), set(base[:n])
            for k in range(rng.randrange(0, max(2, n // 4))):
                (x if rng.random() < 0.5 else y).discard(rng.choice(base[:n]))
                (x if rng.random() < 0.5 else y).add(base[n + k])
            if x and y and 100 * len(x & y) >= num * len(x | y):
                a, b = (set(method.signatures(np.array(sorted(s), np.uint64)).tolist()) for s in (x, y))
                assert a & b, (num, len(x), len(y), len(x & y))


def test_components(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 80)
    edges = [(ids[i], ids[i + 1]) for i in range(30)] + [(ids[40], i) for i in ids[41:60]] + [(ids[70], ids[71]), (ids[5], ids[5])]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({label[i] for i in ids[:31]}) == 1 and len({label[i] for i in ids[40:60]}) == 1 and len(set(label.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme/net/", "HTTP://Example.NET/en/1?x#y", "http://a.example.net/de/1", "http://net", "http://x.org/fr/2", "http://example.com/de/9", "http://e://net/a?b://c", "http://notnet/x", "http://h.com#/net/"]
    urls += [f"http://shop.com/item/{i}" for i in range(30)] + [f"http://bad.net/spam/{i}" for i in range(12)]
    rows = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 2)] == [("", "")] * 3
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[4]["rule"] == "net/" and got[4]["verdict"] == "block" and got[5]["rule"] is None and got[5]["path"] == ""
    assert got[6]["verdict"] == "allow" and got[7]["rule"] == "example.com/de/" and got[8]["host"] == "e:" and got[9]["rule"] is None
    assert got[10]["host"] == "h.com" and got[10]["path"] == ""
    assert {got[i]["template"] for i in range(11, 41)} == {"/item/*"} and all(got[i]["verdict"] == "allow" for i in range(11, 41))
    assert url_filter.judge_urls(rows.where("false")).count() == 0


def test_urls_labels_reach_branches_that_look_the_same(spark):
    """A rule's blocked branch takes an unlabelled one of the same shape along, not one of another shape, nor one with labels of its own."""
    urls = [f"http://spam.example.com/de/{i}" for i in range(40)] + [f"http://spam.example.com/it/{i}0" for i in range(30)]
    urls += [f"http://spam.example.com/about/{''.join(chr(97 + (i * 7 + k) % 26) for k in range(5))}" for i in range(30)]
    urls += [f"http://few.example.com/de/{i}" for i in range(3)] + [f"http://few.example.com/it/{i}" for i in range(9)]
    urls += [f"http://mixed.org/fr/{i}" for i in range(30)] + [f"http://mixed.org/no/{i}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r for r in url_filter.judge_urls(rows).collect()}
    of = lambda start: [(r["verdict"], round(r["purity"], 3)) for u, r in got.items() if u.startswith(start)]
    assert set(of("http://spam.example.com/it/")) == {("block", round(42 / 44, 3))} and all(r["rule"] is None for u, r in got.items() if "/it/" in u)
    assert set(of("http://spam.example.com/about/")) == {("allow", 0.5)}
    assert set(of("http://few.example.com/it/")) == {("allow", round(5 / 7, 3))}
    assert set(of("http://mixed.org/no/")) == {("allow", round(2 / 34, 3))}
    rules = (("block", "h.net", "/a/"), ("allow", "h.net", "/b/"))
    pages = [f"http://h.net/{x}/{i}" for x in "abc" for i in range(40)]
    got = {pages[r["page_id"]]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), rules).collect()}
    purity = {x: {round(r["purity"], 3) for u, r in got.items() if f"/{x}/" in u} for x in "abc"}
    assert purity == {"a": {round(42 / 44, 3)}, "b": {round(2 / 44, 3)}, "c": {0.5}}


def test_quality_is_fitted_on_every_label(spark, monkeypatch):
    """Sums of many tasks give the trees of all rows at once, and no label is left out."""
    rng = np.random.default_rng(5)
    n = 3000
    rows = [(i, i, *map(int, v)) for i, v in enumerate(rng.integers(1, 400, (n, len(quality.COUNTS))))]
    counts = spark.createDataFrame(rows, "doc_id long, th long, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    labels = spark.createDataFrame([(i, int(r[4] < 200)) for i, r in enumerate(rows)], "doc_id long, quality int")
    seen, cut = [], []
    grow = quality.BoostedTrees.grow

    def watched(self, cuts, share, monotone, sums):
        def kept(ask):
            out = sums(ask)
            seen.append(out[2, :, 0].sum())
            return out

        cut.append((cuts, share))
        return grow(self, cuts, share, monotone, kept)

    monkeypatch.setattr(quality.BoostedTrees, "grow", watched)
    monkeypatch.setattr(quality, "TASK_ROWS", 500)
    model, least = quality.train(counts, labels)
    monkeypatch.undo()
    held = {r[0] for r in counts.where("pmod(xxhash64(7, doc_id), 5) = 0").select("doc_id").collect()}
    assert max(seen) == n - len(held)
    table = np.array(rows)
    x = quality.features({c: table[:, 2 + k] for k, c in enumerate(quality.COUNTS)})
    fit = np.array([i not in held for i in range(n)])
    y = (table[:, 4] < 200).astype(float)
    binned = quality.bin_numbers(x[fit], cut[0][0])
    whole = quality.BoostedTrees().grow(*cut[0], np.array(list(quality.FEATURES.values())), lambda ask: quality.histograms(binned, y[fit], ask))
    assert np.allclose(whole.predict(x), model.predict(x))
    good = np.sort(model.predict(x[~fit & (y == 1)]))
    assert least == pytest.approx(good[int(0.005 * len(good))], abs=1e-8)
