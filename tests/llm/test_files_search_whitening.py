"""Token files, ranked search and whitening against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from slotbook.llm import lexical_search, token_files, whitening
from slotbook.session import scratch_path


@pytest.fixture(scope="module")
def content():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


# --- token files ---------------------------------------------------------------------------
@pytest.mark.parametrize("counts", [[7], [1, 1], [1] * 3000 + [10**9], list(range(1, 500)), [10**6, 1, 10**6, 3]])
def test_coder_gives_the_ids_back(counts):
    counts = np.array(counts)
    ids = np.sort(np.random.default_rng(1).permutation(60_000)[:len(counts)])
    freq = token_files.scaled(counts)
    assert freq.sum() == 1 << token_files.SCALE and (freq > 0).all()
    table = token_files.Table(ids, freq)
    draw = np.random.default_rng(2)
    for n in (1, 31, 32, 33, 8193, token_files.BLOCK):
        some = draw.choice(ids, size=(3, n), p=counts / counts.sum())
        some[0] = ids[np.argmin(counts)]  # the rarest alone
        blocks = table.encode(some)
        assert all(np.array_equal(a, b) for a, b in zip(table.decode(blocks), some))
        last = (-(-n // token_files.LANES) - 1) // token_files.EVERY
        for point in range(last + 1):  # reading from any checkpoint
            first = point * token_files.EVERY * token_files.LANES
            assert all(np.array_equal(a, b[first:]) for a, b in zip(table.decode(blocks, point), some))


def test_coder_is_near_the_entropy():
    counts = np.array([1 << k for k in range(16)])
    table = token_files.Table(np.arange(16), token_files.scaled(counts))
    p = counts / counts.sum()
    ids = np.random.default_rng(3).choice(16, size=(4, token_files.BLOCK), p=p)
    bits = 8 * sum(map(len, table.encode(ids))) / ids.size
    assert bits < -(p * np.log2(p)).sum() + 0.35  # 0.27 of it heads and checkpoints


def test_damaged_blocks_are_refused():
    table = token_files.Table(np.arange(4), token_files.scaled(np.array([4, 3, 2, 1])))
    block = table.encode(np.array([[0, 1, 2, 3] * 50]))[0]
    for k in (0, 5, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            table.decode([bytes(bad)])
    other = token_files.Table(np.arange(4), token_files.scaled(np.array([1, 3, 2, 4])))
    with pytest.raises(ValueError):
        other.decode([block])


def test_joined_checksums():
    rng = random.Random(4)
    for _ in range(20):
        parts = [rng.randbytes(rng.choice([0, 1, 4, 999])) for _ in range(rng.randrange(1, 6))]
        assert token_files.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def _by_hand(rows, content):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(content)
    return [(r[0], [*made.encode(r[1] or "", add_special_tokens=False).ids, token_files.END_ID]) for r in rows]


@pytest.mark.parametrize("piece, part", [(1 << 20, 1 << 25), (700, 5000)])
def test_token_files(spark, corpus, nothing, content, monkeypatch, piece, part):
    monkeypatch.setattr(token_files, "PIECE_IDS", piece)
    monkeypatch.setattr(token_files, "PART_IDS", part)
    rows, df = corpus
    odd = [(500, "x's DON'T 12,5 <|endoftext|>  é   Ǆ ﬁ \t日本語 " * 3, "en", "s", 1), (501, "a" * 5000, "en", "s", 1)]
    df = df.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in _by_hand(rows + odd, content))
    at = scratch_path(spark, "test-token-files")
    token_files.write(df, content, at)
    got = sorted(token_files.documents(spark, at).collect(), key=lambda r: r.start)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    place = 0
    for r in got:  # in ascending order, without gaps
        assert r.start == place
        place += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    pieces = collections.defaultdict(list)
    for r in token_files.read(spark, at).collect():
        pieces[r.row, r.doc_id].append((r.part, r.at, r.ids))
    whole = sorted(((i, [x for p in sorted(v) for x in p[2]]) for (_, i), v in pieces.items()), key=str)
    assert whole == sorted(_by_hand(rows + odd, content), key=str)
    assert max(len(x) for _, x in whole) > 20_000


def test_token_files_of_nothing(spark, nothing, content):
    at = scratch_path(spark, "test-token-files")
    token_files.write(nothing, content, at)
    assert token_files.documents(spark, at).count() == token_files.read(spark, at).count() == 0


def test_many_documents_of_one_id(spark, content):
    rows = [(7, f"text {k % 40}") for k in range(3000)] + [(k, "x") for k in range(5)]
    at = scratch_path(spark, "test-token-files")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), content, at)
    got = token_files.documents(spark, at).collect()
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in _by_hand(rows, content))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert len({r.start for r in got}) == len(rows)


def test_tokenizer_that_needs_white_space_is_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_files.check_tokenizer(f.read())


# --- ranked search ---------------------------------------------------------------------------
def _terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _ranked_by_hand(docs, queries, k):
    bags = [(i, collections.Counter(_terms(t))) for i, t in docs]
    n_all = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        want = collections.Counter(_terms(text))
        found = []
        for i, bag in bags:
            score, n = 0, sum(bag.values())
            for t, times in want.items():
                if t in bag:
                    w = math.floor(1000 * math.log((2.0 * n_all + 2) / (2.0 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * n * n_all // length)))
            if score > 0:
                found.append((-score, i is None, i or 0, i, score))
        out += [(item, r + 1, i, s) for r, (*_, i, s) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return collections.Counter(out)


def _search_data():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["The", "OF", "größe", "x.y", "42"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return rng.choice([" ", "\n", "--"]).join(rng.choices(words, weights, k=n))

    docs = [(k, text(rng.choice([1, 3, 10, 40, 200]))) for k in range(400)]
    docs += [(1000 + k, docs[k % 7][1]) for k in range(80)]  # ties
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, " .!? "), (2003, "w1 " * 30_000), (2004, "the")]
    queries = [(k, text(rng.choice([1, 2, 8, 60]))) for k in range(30)]
    queries += [(3, queries[3][1]), (None, "w1 w2"), (77, None), (78, "?"), (79, "neverseen"), (80, "The the THE of w1")]
    return docs, queries


@pytest.mark.parametrize("short, window, run, k", [(0.25, 64, 16, 10), (0.0, 3, 2, 10), (50.0, 4, 1, 3), (0.5, 8, 2, 1)])
def test_ranked_search(spark, monkeypatch, short, window, run, k):
    monkeypatch.setattr(lexical_search, "SHORT", short)
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    monkeypatch.setattr(lexical_search, "RUN", run)
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 6000)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 100)
    docs, queries = _search_data()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "3 as item").repartition(4)
    q = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "'x' as term", "4 as doc_id")
    got = lexical_search.rank(d, q, k)
    assert dict(got.dtypes)["rank"] == "int"
    assert collections.Counter(map(tuple, got.collect())) == _ranked_by_hand(docs, queries, k)


def test_ranked_search_of_nothing(spark, nothing):
    q = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.rank(nothing, q).count() == 0
    assert lexical_search.rank(q.withColumnRenamed("item_id", "doc_id"), q.limit(0)).count() == 0
    only = [tuple(r) for r in lexical_search.rank(q.withColumnRenamed("item_id", "doc_id"), q).collect()]
    assert set(only) == set(_ranked_by_hand([(1, "w1")], [(1, "w1")], 10))


def test_long_lists_are_skipped():
    """A window that cannot reach the k-th score is not evaluated."""
    import pyarrow as pa

    texts = ["rare common"] * 12 + ["common"] * 5000
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    row = next(lexical_search._shards([batch])).to_pylist()[0]
    hashes, _ = lexical_search._terms(np.frombuffer(b"rare common", np.uint8), np.array([0, 11]))
    block = lexical_search.Block([(0, int(h), 1) for h in hashes.view(np.int64)])
    block.weigh({k: 12 if h == hashes[0] else 5012 for k, h in enumerate(block.terms)}, 6000)
    shard = lexical_search.Shard(row, block, 6000, 6000)
    best, windows = lexical_search.Best(10), []
    offer = best.offer
    best.offer = lambda score, doc, null: (windows.append(len(doc)), offer(score, doc, null))
    shard.rank(*block.of[0], block.weight, best, np.arange(len(texts)), np.zeros(len(texts), bool))
    assert sorted(best.doc.tolist()) == list(range(10)) and windows == [12]


# --- whitening ---------------------------------------------------------------------------------
def _whitened_by_hand(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    z = n * x - sums
    cov = np.array([[int((z[:, a] * z[:, b]).sum()) / n**3 for b in range(x.shape[1])] for a in range(x.shape[1])])
    return [i for i, _ in rows], n, (z**2).sum(axis=1), (z / n).astype(float), cov


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for bits, kind in ((1, np.int64), (11, np.int64), (30, np.int64), (47, object)):
        y = rng.integers(0, 1 << bits, size=(201, 5))
        want = y.astype(object).T @ y.astype(object)
        got = whitening.products(y, bits)
        assert all(got[a, b] == want[a, b] for a in range(5) for b in range(a, 5)), kind


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11),
             (904, [1.0] * 5 + [None] + [1.0] * 6)]
    odd = [(905, []), (906, [1.0, 2.0])]  # of another length
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "2 as component").repartition(3)
    ids, n, deviation, centred, cov = _whitened_by_hand(rows)
    got = collections.defaultdict(list)
    for r in whitening.whiten(df).collect():
        got[r.component].append(r)
    values, axes = np.linalg.eigh(cov)
    assert sorted(got) == list(range(1, 9))
    for k, out in got.items():
        assert len(out) == n and {r.n for r in out} == {n}
        own = sorted(((r.vec_id or -1, r.deviation, r.whitened) for r in out))
        want = sorted((i or -1, int(d), float(c @ axes[:, -k] / math.sqrt(values[-k]))) for i, d, c in zip(ids, deviation, centred))
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(own, want)))
        assert [a[:2] for a in own] == [b[:2] for b in want]
        assert np.allclose([sign * a[2] for a in own], [b[2] for b in want], atol=1e-8)
        assert abs(out[0].explained - values[-k] / cov.trace()) < 1e-12 and 0 <= out[0].identity_error < 1e-9


def test_whitening_flat_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    # one flat dimension, one of great numbers, one that does not count
    rows = [(k, [1.5, (-1.0) ** k * 2.0**30 * k]) for k in range(8)] + [(99, [0.0, 1e300])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    ids, n, deviation, centred, cov = _whitened_by_hand(rows[:-1])
    assert {r.vec_id for r in got} == set(range(8)) and len(got) == 16
    want = {i: d if d < 2**63 else None for i, d in zip(ids, deviation)}
    assert None in want.values()
    for r in got:
        assert r.deviation == want[r.vec_id]
        if r.component == 1:
            assert math.isclose(abs(r.whitened), abs(centred[r.vec_id, 1]) / math.sqrt(cov[1, 1]), rel_tol=1e-9) and r.explained == 1.0
        else:
            assert r.whitened is None


# --- html -------------------------------------------------------------------------------------
def test_html_parts_of_the_article_stay():
    from slotbook.llm import html_extract

    paragraph = "A long paragraph, with commas, and a lot of words to count, of the story."
    story = ("<div id=story><div>" + f"<p>{paragraph}</p>" * 8 + "</div><h2>Head</h2><ul><li>one</li><li>two</li></ul>"
             "<table><tr><td>a</td><td>b</td></tr></table></div><ul><li><a href=x>link</a></li></ul>")
    assert html_extract.main_text(story).split("\n\n") == [paragraph] * 8 + ["Head", "one", "two", "a", "b"]
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be one.</p></article>") == "Let x=2 be one."


@pytest.mark.parametrize("start, end", [("<div>", "</div>"), ("<b>", "</b>"), ("<div class=ad><b>", "</b></div>"), ("<i>", "</u>")])
def test_html_nested_deeply(start, end):
    import time

    from slotbook.llm import html_extract

    began = time.process_time()
    assert html_extract.main_text(start * 50_000 + "<p>Deep text, here.</p>" + end * 50_000) == "Deep text, here."
    assert time.process_time() - began < 60


# --- mixing ------------------------------------------------------------------------------------
def test_posteriors_by_hand(spark):
    import xxhash

    from slotbook.llm import mixing

    rng = random.Random(11)
    words = {d: [f"{d}{i}" for i in range(40)] + [f"all{i}" for i in range(20)] for d in "abc"}
    rows = [(i, " ".join(rng.choices(words["abc"[i % 3]], k=rng.choice([3, 30, 400])))) for i in range(60)] + [(90, None), (91, " "), (92, "Unseen WORDS")]
    labels = [(i, "abc"[i % 3]) for i in range(45)] + [(0, "z"), (90, "b"), (None, "a"), (500, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.Classifier(docs, spark.createDataFrame(labels, "doc_id long, domain string"))
    names = model.domains
    own = {}
    for i, d in labels:
        if i is not None:
            own[i] = min(d, own.get(i, d))

    def bucket(word):
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        return (h - (1 << 64) if h >> 63 else h) % mixing.BUCKETS

    bags = {i: collections.Counter(bucket(w) for w in (t or "").lower().split()) for i, t in rows}
    tokens = collections.Counter({d: 0 for d in names})
    count = {d: collections.Counter() for d in names}
    for i, bag in bags.items():
        if i in own:
            tokens[own[i]] += sum(bag.values())
            count[own[i]] += bag
    shares = [tokens[d] / sum(tokens.values()) for d in names]
    assert np.allclose(model.shares, shares)
    seen = sum((count[d] for d in names), collections.Counter())
    common = [(seen[b] + 1) / (sum(seen.values()) + mixing.BUCKETS) for b in range(mixing.BUCKETS)]
    got = {r.doc_id: r for r in model.posteriors(docs).collect()}
    assert set(got) == set(bags)
    for i, bag in bags.items():
        n = sum(bag.values())
        logs = []
        for d, share in zip(names, shares):
            likely = sum(k * math.log((count[d][b] + mixing.SHRINK * common[b]) / (sum(count[d].values()) + mixing.SHRINK)) for b, k in bag.items())
            told = 0.0 if i not in own else math.log(mixing.TRUST) if own[i] == d else math.log((1 - mixing.TRUST) / (len(names) - 1))
            logs.append(likely * min(1.0, mixing.EVIDENCE / max(n, 1)) + math.log(share) + told)
        whole = sum(math.exp(x - max(logs)) for x in logs)
        assert got[i].n_tokens == n
        assert np.allclose([got[i][f"p{k}"] for k in range(len(names))], [math.exp(x - max(logs)) / whole for x in logs], atol=1e-12)


def test_rates_stay_in_their_box_and_keep_documents(spark):
    from slotbook.llm import mixing

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = mixing.source_labels(docs)
    got = mixing.mix(docs, labels).collect()
    assert all(0 <= r.rate <= mixing.MAX_RATE and r.copies <= mixing.MAX_RATE for r in got)
    assert sum(r.copies > 0 for r in got) >= len(got) / 2
    told = mixing.report(docs, labels).collect()
    assert abs(sum(r.target for r in told) - 1) < 1e-9 and all(abs(r.reached - r.target) < 1e-3 for r in told)
    # a target that no rate of at most MAX_RATE can meet is missed, and said so
    rare = min(told, key=lambda r: r.share).domain
    missed = {r.domain: r for r in mixing.report(docs, labels, {rare: 1.0}).collect()}
    assert missed[rare].target == 1.0 and missed[rare].reached < 1.0 and math.isclose(sum(r.share for r in missed.values()), 1.0)


def test_spelled_pieces_are_kept_between_tasks(monkeypatch):
    """The tasks of a worker share a speller, and a piece goes through the model once."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    token_files.speller.cache_clear()
    lines = []
    model = token_files.Speller._model_ids
    monkeypatch.setattr(token_files.Speller, "_model_ids", lambda self, line: lines.append(line) or model(self, line))
    words = ["Great-river", "river", "x1y", "größe", "don't", "river!"]
    whole = [token_files.speller(content).ids(words) for _ in range(2)]
    assert len(lines) == 1 and sorted(lines[0].split()) == sorted(set(lines[0].split()))
    assert whole[0][0].tolist() == whole[1][0].tolist() and whole[0][1].tolist() == whole[1][1].tolist()
    want = [token_files.speller(content).whole.encode(w, add_special_tokens=False).ids for w in words]
    assert whole[0][0].tolist() == sum(want, []) and whole[0][1].tolist() == [len(x) for x in want]
