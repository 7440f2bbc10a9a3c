"""Each operator against brute force on a small corpus with nulls, empty and long
texts, ties, repeated rows and clashing column names; and on empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from slotbook.llm import (
    decontaminate,
    html_extract,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    substring_dedup,
    toxicity,
)

LABELS = "doc_id long, quality int, toxic int"


def _by_id(rows, df, *names):
    got = collections.defaultdict(list)
    for r in df.select("doc_id", *names).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert sum(map(len, got.values())) == len(rows)
    return got


def _split(t):
    return (t or "").encode().split()


def test_substring_dedup(corpus, nothing):
    rows, df = corpus
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = _split(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    got = _by_id(rows, substring_dedup.dedup(df), "n_words", "n_removed", "kept_sha256")
    removed = 0
    for i, t, *_ in rows:
        w = _split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        removed += len(w) - len(kept)
        assert (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) in got[i]
    assert removed > 1000
    assert substring_dedup.dedup(nothing).count() == 0


def test_substring_dedup_keeps_other_text_and_columns(corpus, nothing):
    rows, df = corpus
    out = substring_dedup.deduplicated(df)
    assert out.columns == df.columns and out.count() == len(rows)
    text = {r.doc_id: r for r in out.collect()}
    assert text[3].text == rows[2][1] or not text[3].text.split()
    assert text[12].text == rows[11][1] and text[7].text is None
    assert text[6].n_chars == len(text[6].text) and text[6].span_of == "own"
    assert substring_dedup.deduplicated(nothing).count() == 0


def test_substring_dedup_shuffles_texts_once(spark, corpus, tmp_path):
    rows, df = corpus
    df.write.parquet(f"{tmp_path}/docs")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        out = substring_dedup.deduplicated(spark.read.parquet(f"{tmp_path}/docs"))
        assert len(out.collect()) == len(rows)
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    scanned = r" Exchange hashpartitioning.*\n(?:.*(?:Project|ColumnarToRow).*\n)*.*FileScan parquet \[[^\]]*\btext#"
    assert len(re.findall(scanned, plan)) == 1


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,0)"])
def test_substring_dedup_keeps_the_type_of_doc_id(spark, kind):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("x", passage, 1), ("y", f"one {passage} two", 2)], "anchors string, text string, doc_id long")
    out = substring_dedup.deduplicated(df.withColumn("doc_id", df.doc_id.cast(kind)))
    assert out.dtypes == [("anchors", "string"), ("text", "string"), ("doc_id", kind)]
    assert {(r.anchors, " ".join(r.text.split()), int(r.doc_id)) for r in out.collect()} == {("x", passage, 1), ("y", "one two", 2)}


def _shingles(t):
    w = _split(t.lower() if t else t)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(corpus, nothing):
    rows, df = corpus
    sets = {i: _shingles(t) for i, t, *_ in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = _by_id(rows, near_dedup.near_duplicates(df), "n_shingles", "component_id", "kept")
    for i in sets:
        assert set(got[i]) == {(len(sets[i]), root(i), root(i) == i)}
    assert len({root(i) for i in sets}) < len(sets) - 10
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = [r.doc_id for r in near_dedup.one_each(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i in sets if root(i) == i)
    assert kept.count(None) == 2


def test_setsketch_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2200]), np.unique(pool[400:])
    reg = [near_dedup.registers(x, np.array([0, len(x)]))[0] for x in (a, b, np.unique(pool))]
    assert (np.maximum(reg[0], reg[1]) == reg[2]).all()  # sketch of the union
    j = np.arange(0.05, 1, 0.01)
    above, below = (reg[0] > reg[1]).sum(), (reg[0] < reg[1]).sum()
    best = j[np.argmax([near_dedup.log_likelihood(len(a), len(b), above, below, near_dedup.REGISTERS - above - below, x) for x in j])]
    assert abs(best - len(np.intersect1d(a, b)) / 3000) < 0.15


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (50, 60)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40}


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_components_take_few_jobs(spark, coalesce):
    """Every shuffle and broadcast of a loop costs the driver threads for a minute."""
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 400)] + [(1000, 900), (1000, 950), (950, 901)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.sparkContext.setJobGroup("few", "components")
    try:
        got = {r.node: r.component for r in near_dedup.components(links).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {k: 0 for k in range(401)} | {900: 900, 901: 900, 950: 900, 1000: 900}
    assert coalesce == "false" or jobs <= 8


def test_mixing(spark, corpus, nothing):
    rows, df = corpus
    got = mixing.mix(df, mixing.source_labels(df)).collect()
    assert len(got) == len({r[0] for r in rows})  # one row a doc_id
    assert all(r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in got)
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.rate * r.n_tokens for r in got) / total - 1) < 0.1
    assert mixing.mix(nothing, mixing.source_labels(nothing)).count() == 0
    out = mixing.mixed(df, mixing.source_labels(df))
    assert set(df.columns) < set(out.columns) and out.count() <= len(rows)


def test_rates_meet_targets(spark):
    data = [(i, 10, 0.9 if i % 4 else 0.1, 0.1 if i % 4 else 0.9) for i in range(400)]
    rows = spark.createDataFrame(data, "doc_id long, n_tokens long, p0 double, p1 double")
    got = mixing.fit_rates(rows, [0.5, 0.5], 40).collect()
    reached = [sum(r.rate * 10 * p(r) for r in got) / 4000 for p in (lambda r: r.p0, lambda r: r.p1)]
    assert max(abs(x - 0.5) for x in reached) < 0.01


@pytest.mark.parametrize("hot", [1, 60])
def test_mix_meets_targets_per_domain(spark, monkeypatch, hot):
    """The production call, with a third to nearly all of the documents of one source."""
    monkeypatch.setattr(mixing, "SHRINK", 50)  # few documents here: else all look alike and targets are out of reach
    rng = random.Random(4)
    words = {d: [f"{d}{i}" for i in range(30)] + [f"all{i}" for i in range(300)] for d in "abcde"}
    rows = [(i, d, " ".join(rng.choice(words[d]) for _ in range(40)))
            for i, d in enumerate(("abcde" + "a" * hot) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = mixing.source_labels(docs)
    model = mixing.Classifier(docs, labels)
    k = len(model.domains)
    wanted = [s**mixing.FLATTEN for s in model.shares]
    both = mixing.mix(docs, labels).join(model.posteriors(docs).drop("n_tokens"), "doc_id").collect()
    total = sum(r.n_tokens for r in both)
    reached = [sum(r.rate * r.n_tokens * r[f"p{i}"] for r in both) / total for i in range(k)]
    assert k == 5 and max(abs(x - w / sum(wanted)) for x, w in zip(reached, wanted)) < 1e-5


def test_mix_domains_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_LABELLED", 3)
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 5)
    rows = [(i, "abcdefg"[i % 7], f" {'word ' * (10 + i % 7)}\n") for i in range(70)] + [(1000, "tiny", "word"), (None, "g", "word word")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = mixing.source_labels(docs)
    size = collections.Counter()
    for _, d, t in rows:
        size[d] += len(t.split())
    total = sum(size.values())
    model = mixing.Classifier(docs, labels)
    assert model.domains == ["g", "f", "e", "d", "*"]
    want = [size[d] / total for d in "gfed"]
    assert np.allclose(model.shares, [*want, 1 - sum(want)])
    assert mixing.Classifier(docs, labels, {"tiny": 1, "*": 2}).domains == ["g", "f", "e", "tiny", "*"]
    for targets in ({"absent": 1}, dict.fromkeys("abcde", 1)):
        with pytest.raises(ValueError):
            mixing.mix(docs, labels, targets)


def test_rates_of_unreachable_targets(spark):
    rows = spark.createDataFrame([(i, 10, 0.5, 0.5) for i in range(20)] + [(99, 20, 0.4, 0.6)], "doc_id long, n_tokens long, p0 double, p1 double")
    got = mixing.fit_rates(rows, [0.9, 0.1]).collect()
    reached = [sum(r.rate * r.n_tokens * p for r, p in zip(got, ps)) / 220 for ps in ([r.p0 for r in got], [r.p1 for r in got])]
    # nearest point of the cone between (0.5, 0.5) and (0.4, 0.6) to (0.9, 0.1)
    assert max(abs(x - 0.5) for x in reached) < 1e-3


def test_license_scan(spark, nothing):
    rows = [(1, "Plain words here.\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License. And more words of text."),
            (3, "It was a plain day."), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
            (7, "Licensed under the Acme Community License, version 9."), (7, "Licensed under the Acme Community License, version 9.")]
    rows += [(100 + i, f"The sun was over the hill number {i} and it went under in the evening of day {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' as words", "1 as row")
    got = _by_id(rows, license_scan.license_scan(df), "license")
    assert got[1] == [("apache",)] and got[2] == [("mit",)] and got[6] == [("cc-by-nc,gpl",)]
    assert got[3] == got[4] == got[5] == [("none",)] and got[7] == [("unknown",)] * 2
    assert all(got[100 + i] == [("none",)] for i in range(60))
    assert license_scan.license_scan(nothing).count() == 0


def test_lm_scores(corpus, nothing):
    rows, df = corpus
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*_split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    count = collections.Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = _by_id(rows, lm_scoring.lm_scores(df), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want = (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert any(g[:4] == want and abs(g[4] - base) < 1e-6 * abs(base) + 1e-9 and g[5] < 0 for g in got[i])
    assert lm_scoring.lm_scores(nothing).count() == 0


def test_lm_is_a_distribution():
    words = lm_scoring.Vocabulary([(5, 10), (7, 3), (-2, 3)], 20, 5, {40: (2, 1)})
    views = lm_scoring._views(words.biases())
    rng = np.random.default_rng(0)
    views["c"][:] = rng.normal(size=views["c"].shape)
    views["s"][:] = rng.normal(size=views["s"].shape)
    wide, near = np.array([[3], [9], [11]]), np.array([[4], [lm_scoring.NEAR + 6]])
    total = 0.0
    for cls in range(lm_scoring.CLASSES):
        p, q = lm_scoring.probabilities(views, wide, near, np.array([cls]))
        total += p[0, cls] * q[0].sum()
    assert abs(total - 1) < 1e-5


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "Short item here"), (3, None),
         (4, ""), (5, "Short item here"), (12, "solo")]


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_decontamination(spark, nothing, chunk):
    long_item = ITEMS[0][1]
    rows = [(1, "x " + long_item.upper().replace(" ", ", ") + " y"), (2, "a short, item HERE b " + "c " * 90), (3, None), (4, ""),
            (5, " ".join(long_item.split()[:12])), (6, "solo"), (6, "solo"), (7, "solo " * 3 + "none " * 100), (None, "solo b"), (8, "clean words " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_hit", "'x' as items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = _by_id(rows, decontaminate.contamination(docs, bench, chunk_chars=chunk), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for i, t in rows:
        w = rx.findall((t or "").lower())
        hit, items = set(), set()
        for k, text in ITEMS:
            x = rx.findall((text or "").lower())
            z = min(13, len(x))
            for a in range(len(x) - z + 1 if x else 0):
                for b in range(len(w) - z + 1):
                    if w[b:b + z] == x[a:a + z]:
                        hit |= set(range(b, b + z))
                        items.add(str(k))
        want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                bool(hit) and 20 * len(hit) >= len(w))
        assert want in got[i]
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 8}


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_repeated_benchmark_rows_all_count(spark, chunk):
    items = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta words"), (2, "alpha beta gamma"), (None, "solo"), (None, "solo")] + [(7, f"filler {k}") for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(1, "x alpha beta gamma solo y delta words"), (2, "filler 3"), (2, "filler 3")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, chunk_chars=chunk).collect()}
    assert got[1].n_items == 6 and got[1]["items"] == ["1", "1", "1", "2", "None", "None"] and got[1].n_hit == 6
    assert got[2].n_items == 1


def test_benchmark_chunks_are_bounded(spark):
    items = [(1, "word " * 4 + str(k)) for k in range(50)] + [(None, "x" * 100)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    chunks = [(some, rows) for some, rows in decontaminate._chunks(bench, 90)]
    assert sorted(r for _, rows in chunks for r in rows) == sorted({r for _, rows in chunks for r in rows})
    assert sorted(t for some, _ in chunks for _, t in some) == sorted(t for _, t in items)
    assert all(len(some) == 1 or sum(len(t) + 1 for _, t in some) <= 90 for some, _ in chunks)


def test_quality_rules(corpus, nothing):
    rows, df = corpus
    got = _by_id(rows, quality_rules.quality_rules(df), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "longest_repeat")
    for i, t, *_ in rows:
        if i == 12:
            continue
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        hit = {j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if x.split()]
        longest = max([0, *(n for n in range(3, len(w)) if len({tuple(w[k:k + n]) for k in range(len(w) - n + 1)}) < len(w) - n + 1)])
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
                len(w) < 50 or 100 * len(hit) > 50 * len(w), longest)
        assert want in got[i]
    assert quality_rules.quality_rules(nothing).count() == 0


def _labelled(spark, n=400):
    good = ["the river runs over warm stones today", "people of the town walk home in light"]
    bad = ["BUY!! NOW!! CHEAP!! DEALS!! HERE!! WOW!!", "click | here | free | win | now | ok"]
    rows = [(i, " ".join((good if i % 3 else bad)[(i + k) % 2] + f" n{i * 7 + k}" for k in range(6))) for i in range(n)]
    rows = [(i, t + (" you stupid clown" if i % 5 == 1 else "")) for i, t in rows]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 1)) for i in range(n)] + [(None, 1, 1), (3, None, None)]
    rows += [(9001, None), (9002, ""), (None, "a b"), (9003, "w " * 30_000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as score"), spark.createDataFrame(labels, LABELS)


def test_quality_classifier_held_out(spark, nothing):
    rows, docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) >= 0.95
    assert quality_classifier.quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {1.0}
    assert quality_classifier.accepted(docs, labels).columns == docs.columns


def test_toxicity_held_out(spark, nothing):
    rows, docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert np.mean([r.predicted == (r.doc_id % 5 == 1) for r in held]) >= 0.95
    text = dict(rows)
    spans = {text[i][a:b] for i, r in got.items() if r.predicted for a, b in zip(r.starts, r.ends)}
    assert spans and spans <= {"stupid", "clown", "you"}
    assert got[9001].score == got[9002].score == 0
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_rare_label(spark, monkeypatch):
    """Words are counted over all labels and rare toxic documents are trained on, though the sample is small."""
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 100)
    rows = [(i, f"the town n{i % 50} walks home" + (" clown" if i % 200 == 7 else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 200 == 7)) for i, _ in rows], LABELS)
    known = toxicity.usable(labels, "toxic")
    toxic = known.filter("label = 1").count()
    got = toxicity.training_labels(known, known.count(), toxic).collect()
    assert len(got) == 100 and sum(r.label for r in got) == min(toxic, 10)
    joined = docs.join(known, "doc_id")
    buf = np.frombuffer(b"clown", np.uint8)
    assert toxicity.lexicon(joined, joined.count(), toxic).tolist() == toxicity.Text(buf, np.array([0, 5])).h.tolist()
    assert toxicity.train(docs, labels) is not None


def test_crf_marginals_are_exact():
    buf = np.frombuffer(b"a b c d e f g", np.uint8)
    text = toxicity.Text(buf, np.array([0, len(buf)]))
    rng = np.random.default_rng(2)
    field = toxicity.Field(rng.normal(size=toxicity.HASHED + 4))
    got = field.marginals(text)
    emit = field.w[:toxicity.HASHED][text.cells].sum(0) + field.w[toxicity.HASHED]
    move = {(0, 0): 0, (0, 1): field.w[-3], (1, 0): field.w[-2], (1, 1): field.w[-1]}
    want, whole = np.zeros(7), 0.0
    for k in range(2**7):
        y = [(k >> j) & 1 for j in range(7)]
        p = math.exp(sum(e * t for e, t in zip(emit, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        whole += p
        want += p * np.array(y)
    assert np.allclose(got, want / whole)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies, sorry.</div>
%s
<aside>Side, bar.</aside><section id="comments"><p>First comment, a long one, that says very little at all.</p></section>
<form><p>Subscribe, please, to our long letter of news.</p></form><footer>&copy; us</footer><script>var x = "</p>";</script></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h2>Head</h2><p>One, two &amp; three\n  are numbers.<p>Four<br>five, &#233;té.</p></article>", "Head\n\nOne, two & three are numbers.\n\nFour five, été."),
    ("<div id=c><p>A long first paragraph, with commas, and more words than most.</p><div class=ad>Buy!</div><p>Short.</p></div>",
     "A long first paragraph, with commas, and more words than most.\n\nShort."),
    ("<main><section><p>Part one, long enough to count, is here today.</p></section><section><p>Part two.</p></section></main>",
     "Part one, long enough to count, is here today.\n\nPart two."),
])
def test_html_extract(body, want):
    assert html_extract.main_text(PAGE % body) == want


@pytest.mark.parametrize("wrapper", ["div class='content with-sidebar'", "div id=no-sidebar", "div class=has-comments", "form method=post", "div role=form"])
@pytest.mark.parametrize("inner", ["%s", "<article>%s</article>", "<main>%s</main>"])
def test_html_wrappers_keep_the_article(wrapper, inner):
    paragraphs = [f"Paragraph {k} of the article, long enough to count, with commas, and more words than most others have." for k in range(8)]
    body = inner % "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<{wrapper}><div class=sidebar><p>Side, note.</p></div>{body}<div class=comments><p>Nice, thanks.</p></div></{wrapper.split()[0]}>"
    assert html_extract.main_text(PAGE % page) == "\n\n".join(paragraphs)


def test_html_long_comments_stay_out():
    comments = "".join(f"<p>Comment {k}, which goes on, and on, for many words without end.</p>" for k in range(50))
    article = "A paragraph, of the article, that is here to be read. " * 5
    page = f"<article><p>{article}</p></article><div class=comments>{comments}</div>"
    assert html_extract.main_text(PAGE % page) == article.strip()


def test_html_rows(spark):
    rows = [(1, "u", PAGE % "<article><p>Text, here.</p></article>"), (2, None, None), (3, "v", ""), (4, "w", "no tags at all"),
            (5, "x", "<div><p>cut off in the mid"), (6, "y", "<p>" + "long words, " * 50_000), (1, "u", PAGE % "<article><p>Text, here.</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "0 as n_chars")
    got = html_extract.main_texts(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert (text[1], text[2], text[3], text[4], text[5]) == ("Text, here.", "", "", "no tags at all", "cut off in the mid")
    assert len(text[6]) == 50_000 * 12 - 1
    assert html_extract.main_texts(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = P.run(spark, sf_dir)
    assert [n for n, _ in P.STAGES][0] == "quality classifier" and set(docs.columns) < set(out.columns)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    got = out.collect()
    assert got and {r.doc_id for r in got} <= ids and all(r.mix_copies >= 1 for r in got)


def test_license_paragraphs_are_cut_once(spark):
    """A condition on the 3-grams of a paragraph does not cut its text again."""
    from pyspark.sql import functions as F

    p = license_scan._paragraphs(spark.createDataFrame([(1, "A b.\n\nc"), (2, None)], "doc_id long, text string"))
    assert [r.words for r in p.collect()] == [["a", "b"], ["c"]]
    plan = p.filter(F.array_contains(license_scan._grams(F.col("words"), 3), "x y z"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "array_join" in line and "[^a-z0-9.]+" in line]


def test_license_lists_are_hashed_once(spark):
    """Words are looked up in lists that the plan holds hashed, with the results of comparing arrays."""
    from pyspark.sql import functions as F

    grams = ["under the mit", "the mit license", "a b c"] + [f"x{i} y z" for i in range(20)]
    lines = ["released under the MIT. license", "the .. mit license", "a b", "a b c", "A  b\tc... d", "", "x7 y z.", "x y z", "c a b d"]
    words = license_scan._trimmed(license_scan._words(F.col("t")))
    df = spark.createDataFrame([(x,) for x in lines], "t string").select(words.alias("words"))
    rows = df.select("words", license_scan._holds(F.col("words"), grams).alias("holds"),
                     license_scan._has_marker([g.split()[0] for g in grams])(F.col("words")).alias("has"))
    for r in rows.collect():
        assert r.holds == any(" ".join(r.words[i:i + 3]) in grams for i in range(len(r.words) - 2)), r
        assert r.has == bool(set(r.words) & {g.split()[0] for g in grams}), r
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "arrays_overlap" not in plan


def test_lm_gradients_of_equal_rows_are_summed():
    rng = np.random.default_rng(1)
    index = np.sort(rng.zipf(1.4, 5000) % 200).astype(np.uint16)
    grad = rng.normal(size=(5000, 32)).astype(np.float32)
    rows, sums = lm_scoring._summed(index, grad.copy())
    assert rows.tolist() == np.unique(index).tolist()
    for r, x in zip(rows, sums):
        assert np.allclose(x, grad[index == r].astype(np.float64).sum(0), atol=1e-3)


def test_lm_softmax_near_and_far():
    for scale in (1, 50, 1000):
        x = np.random.default_rng(2).normal(size=(64, 32)) * scale
        e = np.exp(x - x.max(1, keepdims=True))
        assert np.allclose(lm_scoring._softmax(x.astype(np.float32)), e / e.sum(1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("step, most", [("contexts", 150), ("phrases", 100)])
def test_steps_of_the_pipeline_hold_little(step, most):
    """MB that a worker holds at once, whatever the size of an Arrow batch."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = quality_classifier._contexts if step == "contexts" else substring_dedup._phrase_rows(50, 5)
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < most


@pytest.mark.parametrize("step", ["pooling", "contexts", "phrases", "sketches"])
def test_steps_hold_a_small_slice(step, monkeypatch):
    """Two workers' steps beside a full JVM: at most 40 MB each, the batch of 10 MB not counted."""
    import tracemalloc
    from types import SimpleNamespace as Made

    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    table = rng.normal(size=(quality_classifier.BUCKETS, quality_classifier.DIM)).astype(np.float32)
    net = Made(score=lambda x: x[:, 0])
    monkeypatch.setattr(quality_classifier, "train", lambda docs, labels: (Made(value=table), net))
    run = {"pooling": quality_classifier.accepted(Made(mapInArrow=lambda f, schema: f, schema=None), None),
           "contexts": quality_classifier._contexts, "phrases": substring_dedup._phrase_rows(50, 5),
           "sketches": near_dedup._sketch_rows}[step]
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print(step, round(peak, 1))
    assert peak < 40
