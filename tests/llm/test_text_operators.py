"""Operators over documents against brute force, held-out accuracy and planted cases; with nulls, repeats and empty tables."""

import itertools
import random
import uuid
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from swipesight.llm import decontaminate, jaccard_join, katz, language, line_dedup, merkle, mixing, queries, surrogates, words

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def edited_copies():
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for size in range(1, 30):
        for v in range(4):
            w = [f"y{size}_{i}" for i in range(size)]
            if v:
                w[rng.randrange(size)] = f"z{rng.randrange(3)}"
            rows.append((1000 + 10 * size + v, " ".join(w)))
    return rows + [(5000, ""), (5001, None), (5002, " \t"), (5003, "a B"), (5004, "A\tb")]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, n, percent):
    rows = edited_copies()
    found = jaccard_join.jaccard_components(table(spark, rows).repartition(5), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.components(rows, n, percent)


def test_jaccard_on_the_given_table(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard_join(spark, SMALL).collect()}
    assert found == brute.components(texts, 3, 90)


def test_jaccard_bitmap_takes_few_jobs(spark):
    """One job for each piece of some MB, not for each shuffle partition."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "bitmap")
    try:
        places = sorted(random.Random(3).sample(range(jaccard_join.KEY_BITS), 500))
        flags = jaccard_join._bitmap(spark.createDataFrame([(i,) for i in places], "at bigint"), jaccard_join.KEY_BITS).value
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert np.flatnonzero(np.unpackbits(flags, bitorder="little")).tolist() == places
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 12


def test_jaccard_long_sets_are_counted_in_fragments(spark):
    rng = random.Random(1)
    long = [f"v{rng.randrange(10**6)}" for _ in range(9000)]
    near = [*long[:8800], *(f"q{i}" for i in range(200))]
    far = [*long[:7000], *(f"r{i}" for i in range(2000))]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far))]
    found = jaccard_join.jaccard_components(table(spark, rows), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.components(rows, 3, 90)


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other"), (4, None)]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(table(spark, rows)).collect()) == [1, 2, 4]


def test_language_held_out(spark, documents):
    known = {r.doc_id: r.lang for r in documents.collect()}
    found = queries.op2_language_id(spark, SMALL).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_corner_cases(spark):
    rows = [(i, "the of and to in that is was", "en") for i in range(5)] + [(i, "der die und das nicht sich ein", "de") for i in range(5, 10)]
    model = language.train(table(spark, rows, "doc_id long, text string, lang string").select("text", "lang"))
    new = [(1, None), (2, ""), (3, "12 34 !"), (4, "und die das"), (5, "the and that " * 50_000), (5, "the and that")]
    found = {(r.doc_id, r.text is None or len(r.text)): r.lang_pred for r in language.identify(table(spark, new), model).collect()}
    assert [v for _, v in sorted(found.items(), key=lambda x: (x[0][0], x[0][1]))] == ["und", "und", "und", "de", "en", "en"]
    none = language.train(table(spark, [], "text string, lang string"))
    assert language.identify(table(spark, new), none).where("lang_pred <> 'und'").count() == 0
    assert language.codewords(20).shape[0] == 20


def test_katz_against_brute_force(spark, texts):
    def out(d):
        return zlib.crc32(str(d).encode()) % 10 == 0

    rows = [*texts[:60], (900, None), (901, ""), (902, "never seen before"), (902, "never seen before")]
    share = 1e-3
    model = brute.Katz([t for d, t in rows if not out(d)], share, katz.CUTOFF, katz.discounts)
    found = katz.score(table(spark, rows), language.held_out(10, 0), share).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        tokens = [*brute.words(text[r.doc_id]), b"\x00end"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out(r.doc_id), len(tokens), model.n)
        assert r.n_known == sum(model.uni[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(sum(brute.log10(model.p1(t)) for t in tokens), abs=1e-6)
        assert r.score == pytest.approx(model.score(text[r.doc_id]), abs=1e-6)


@pytest.mark.parametrize("frequent", [1e-2, 0.5])
def test_katz_tells_rare_words_apart_in_bigrams(spark, texts, frequent):
    # In one common class, the bigrams of rare words would be seen ones.
    rows = [*texts[:8], (900, None), (901, "rare1 rare2 the rare3"), (904, "rare2 rare1 the rare3 never seen"), (10, "rare3 rare1 never of")]
    rows += [(1000 + i, f"rare1 rare2 the word{i}") for i in range(30)]
    held = "doc_id % 7 = 0 OR doc_id = 10"
    model = brute.Katz([t for d, t in rows if d % 7 and d != 10], 0.0, katz.CUTOFF, katz.discounts)
    by_id = {d: [t for e, t in rows if e == d] for d, _ in rows}
    found = katz.score(table(spark, rows), held, frequent=frequent).collect()
    assert len(found) == len(rows)
    for r in found:
        assert any(r.score == pytest.approx(model.score(t), abs=1e-6) for t in by_id[r.doc_id])
        assert any(r.base_score == pytest.approx(sum(brute.log10(model.p1(w)) for w in [*brute.words(t), b"\x00end"]), abs=1e-6) for t in by_id[r.doc_id])


def test_katz_makes_no_arrays_of_values_in_the_bigram_sums(spark, texts):
    source = katz._source(table(spark, [(i, t) for i, t in enumerate(texts[:20])]), "false")
    own = katz.classes(katz.unigrams(source), 20, 0.01, False)
    sums = katz.bigram_sums(source, spark.sparkContext.broadcast(own), own, 0)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and "array<double>" not in plan and "array(p1" not in plan


def test_katz_bigrams_of_a_document_lie_together(spark):
    rng = np.random.default_rng(1)
    doc, a, b = rng.integers(0, 5, 4000), rng.integers(-9, 9, 4000), rng.integers(-9, 9, 4000)
    for key in (words.mix(a.view(np.uint64)), np.zeros(4000, np.uint64) - b.view(np.uint64)):  # the second: all hashes alike
        order = katz._by_bigram(doc, key, a, b, 5)
        runs = [k for k, _ in itertools.groupby(zip(doc[order], a[order], b[order], strict=True))]
        assert len(runs) == len(set(runs)) and sorted(order) == list(range(4000))


@pytest.mark.parametrize("count", [0, 1, 3, 5000])
def test_katz_numbers_frequent_words(count):
    hashes = np.sort(words.words([b" ".join(b"%d" % i for i in range(count))]).hash)
    asked = np.concatenate([hashes, words.words([b"a b c"]).hash, np.array([0, 31, 2**64 - 1], np.uint64)])
    number = {int(h): i for i, h in enumerate(hashes)}
    for lumped in (False, True):
        own = katz.Classes(hashes, np.ones(count, int), count, count, 1, lumped)
        assert own.of(asked).tolist() == [number.get(int(h), count if lumped else -1 - (int(h) >> 1)) for h in asked]


def test_words_hash_by_place_in_the_word():
    """A word's hash depends on its bytes only, whatever block it lies in."""
    texts = [b"", b"Aa b\tAA", "\u00c9 \u00e9x".encode(), b"z" * 1_500_000 + b" aa", b"B"]
    found = words.words(texts)
    alone = [words.words([w]).hash[0] for t in texts for w in t.lower().split()]
    assert found.hash.tolist() == alone and found.first.tolist() == [0, 0, 3, 5, 7, 8]
    with np.errstate(over="ignore"):
        plain = words._BYTE[ord("a")] + words._BYTE[ord("b")] * words._STEP + np.uint64(2)
    assert words.words([b"x AB"]).hash[1] == words.mix(np.array([plain]))[0]


def test_katz_adds_up_to_one():
    model = brute.Katz(["a b a c", "a b b", "c a d"], 0.0, katz.CUTOFF, katz.discounts)
    for h in ["<begin>", b"a", b"b", b"c", b"d"]:
        total = sum(model.p_class(h, c) for c in [*model.classes, "<other>"])
        assert total == pytest.approx(1.0)


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in merkle.with_next(table(spark, texts).repartition(6), 5).collect()}
    ids, text = sorted(d for d, _ in texts), dict(texts)
    for i, d in enumerate(ids):
        own, follower = text[d], text[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + follower[:half]
        assert rows[d].edited_sha256 == merkle.hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[d].n_chars, rows[d].fingerprint) == (len(own), merkle.fingerprint(own))
        assert rows[d].near_next == merkle.likeness(rows[d].fingerprint, merkle.fingerprint(follower))


def test_fingerprint_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, "one. two.\n\nthree"), (4, "one. two.\n\nthree"), (5, "x" * 100_000), (5, "y")]
    found = merkle.with_next(table(spark, rows), 3).orderBy("doc_id", "n_chars").collect()
    assert len(found) == 6 and found[0].fingerprint == found[1].fingerprint and found[0].near_next == 1.0
    assert found[2].near_next == 1.0 and found[2].fingerprint == found[3].fingerprint
    assert merkle.differences(merkle.fingerprint("a. b. c."), merkle.fingerprint("a. x. c.")) == [(3, 3)]
    assert merkle.with_next(table(spark, [])).count() == 0


def test_decontamination_against_brute_force(spark, texts):
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute.contamination(texts, benchmark, 10)
    assert sum(v[1] > 0 for v in want.values()) > 0
    found = queries.op9_decontamination(spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found} == want


@pytest.mark.parametrize("shard_words", [5, 10**6])
def test_decontamination_random_items(spark, shard_words):
    rng = random.Random(5)
    items = [(str(i), " ".join(rng.choice("ABCD") for _ in range(rng.randrange(0, 9)))) for i in range(25)] + [("n", None), ("7", "é1 é2")]
    rows = [(d, " ".join(rng.choice("abcdx") for _ in range(rng.randrange(0, 60)))) for d in range(40)] + [(90, None), (91, "É é1-é2!")]
    found = decontaminate.matches(table(spark, rows), table(spark, items, "item_id string, text string"), 4, shard_words)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found.collect()} == brute.contamination(rows, items, 4)


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before it. {item.upper()}! {'after ' * 20}", "x"), (2, item, "y"), (3, None, "z"), (4, "clean", "w")]
    found = decontaminate.remove_spans(
        table(spark, rows, "doc_id long, text string, items string"), table(spark, [(1, item)], "item_id long, text string")
    )
    assert {r.doc_id: r.text for r in found.collect()} == {1: f"Before it. ! {'after ' * 20}", 3: None, 4: "clean"}
    assert decontaminate.matches(table(spark, rows[:1], "doc_id long, text string, items string"), table(spark, [], "item_id long, text string")).first().n_hit == 0


def test_line_dedup(spark):
    passage = "\n".join(f"shared line {i} of a long passage" for i in range(30))
    single = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"own a\n{passage}\nend a"), (2, f"own b\nmore b\n{passage}\nend b"), (3, f"first\n{single}\nlast"), (4, f"begin\n{single}\nstop"),
            (5, "short\nlines"), (6, None), (7, ""), (8, "Yes.\nunique one"), (9, "Yes.\nunique two")]
    found = {r.doc_id: r for r in line_dedup.remove_repeated(table(spark, [(*r, "k") for r in rows], "doc_id long, text string, begin string")).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1]
    assert found[2].n_removed >= 25 and found[2].text.startswith("own b\nmore b") and found[2].text.endswith("end b")
    assert found[4].text == "begin\nstop" and found[4].n_removed == 1
    assert [found[i].text for i in range(5, 10)] == ["short\nlines", None, "", "Yes.\nunique one", "Yes.\nunique two"]
    assert line_dedup.remove_repeated(table(spark, [])).count() == 0


def test_copies_keep_the_first(spark):
    text = "\n".join(f"line {i} here" for i in range(40))
    found = {r.doc_id: r.text for r in line_dedup.remove_repeated(table(spark, [(5, text), (2, text), (9, text)])).collect()}
    assert found[2] == text and found[5] == found[9] and len(found[5].split("\n")) <= 1


def test_mixing_meets_targets(spark, documents):
    found = queries.op3_mixing(spark, SMALL).collect()
    size = {d: len(brute.words(t)) for d, t in ((r.doc_id, r.text) for r in documents.collect())}
    source = {r.doc_id: r.source for r in documents.collect()}
    taken, target = {}, {}
    for r in found:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    again = queries.op3_mixing(spark, SMALL).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_targets_stop_and_share_again():
    assert mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 8, "b": 1, "c": 1}) == {"a": 30.0, "b": 90.0, "c": 90.0}
    assert mixing.targets({"a": 0, "b": 5}, {"a": 1, "b": 1}) == {"a": 0.0, "b": 5.0}


def test_overlapping_sources_take_the_cheapest_flow():
    # The shared pattern must serve b, since a has words of its own; nothing is repeated.
    flow = mixing.cheapest_flow([(("a",), 10), (("a", "b"), 10)], {"a": 10, "b": 10}, 3)
    assert flow[0].get("a") == 10 and flow[1].get("b") == 10
    rng = random.Random(2)
    for _ in range(60):
        patterns = [(tuple(s for s in "abc" if rng.random() < 0.6) or ("a",), rng.randrange(0, 5)) for _ in range(3)]
        quotas = {s: rng.randrange(0, 7) for s in "abc"}
        flow = mixing.cheapest_flow(patterns, quotas, 2)
        used = [sum(f.values()) for f in flow]
        assert all(u <= 2 * size and min([0, *f.values()]) >= 0 for u, (_, size), f in zip(used, patterns, flow, strict=True))
        total, cost = best_flow(patterns, quotas)
        assert (sum(used), sum(max(0, u - size) for u, (_, size) in zip(used, patterns, strict=True))) == (total, cost)


def best_flow(patterns, quotas):
    """Most words, then fewest repetitions: by trying all uses of the patterns."""
    import itertools

    best = (0, 0)
    for uses in itertools.product(*(range(2 * size + 1) for _, size in patterns)):
        # Hall's condition: every set of patterns must fit into the quotas of its sources.
        fits = all(
            sum(uses[i] for i in some) <= sum(quotas[s] for s in {s for i in some for s in patterns[i][0]})
            for k in range(1, 4) for some in itertools.combinations(range(3), k)
        )
        if fits:
            best = max(best, (sum(uses), -sum(max(0, u - size) for u, (_, size) in zip(uses, patterns, strict=True))))
    return best[0], -best[1]


def test_mixing_corner_cases(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (2, None, "s"), (3, "", "t"), (4, "d e", "t")]
    found = mixing.mix(table(spark, rows, "doc_id long, text string, source string"), "array(source)").collect()
    assert len(found) == 5 and sum(r.taken for r in found) in (7, 8, 9)
    assert mixing.mix(table(spark, [], "doc_id long, text string, source string"), "array(source)").count() == 0


def test_surrogates(spark):
    rows = [
        (1, "Mail ann.lee@mail3.example.com or Ann.Lee@mail3.example.com, card 4111 1111 1111 1111."), (2, "ann.lee@mail3.example.com again; 4111111111111111"),
        (3, "Call +1 (017) 555-7713 from 97.51.17.173"), (4, "Frau Maria Keller und Иван Ткач"), (5, None), (6, "clean text 2024, version 3."),
        (7, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"!!'), (8, "Mr Baker met Maria Keller"),
    ]
    found = {r.doc_id: r.text for r in surrogates.replace_entities(table(spark, rows)).collect()}
    assert found[5] is None and found[6] == rows[5][1]
    one = found[1].split()[1]
    assert one.endswith(".com") and found[2].startswith(one) and "ann" not in found[1].lower()
    card = found[2].split("; ")[1]
    assert card in found[1].replace(" ", "") and card[0] == "4" and card != "4111111111111111" and luhn(card)
    assert found[3].startswith("Call +1 (") and "555-7713" not in found[3] and all(0 < int(o) < 256 for o in found[3].split()[-1].split("."))
    given, family = found[4].split()[1:3]
    assert given in surrogates.GIVEN["f", "latin"].split() and found[8].endswith(f"{given} {family}") and "Keller" not in found[4]
    assert found[4].split()[-2] in surrogates.GIVEN["m", "cyrillic"].split() and found[8].startswith("Mr ")
    assert len(found[7]) == len(rows[6][1]) and "b44e15" not in found[7]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_surrogates_are_distinct(spark):
    rows = [(i, f"Mr {a} and 10.0.{i // 250}.{i % 250}") for i, a in enumerate(surrogates.SURNAMES["latin"].split() * 8)]
    found = surrogates.mapping(table(spark, rows).select(F.explode(F.regexp_extract_all("text", F.lit(surrogates.ANY), F.lit(0))).alias("entity")), "k").collect()
    assert len({r.replacement for r in found}) == len(found) == len({r.entity for r in found})
    assert not {r.replacement for r in found if r.kind == "ip"} & {r.entity for r in found}


def test_pipeline(spark):
    import corpus_pipeline

    before = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == before.columns, name
    kept = corpus_pipeline.run(spark, SMALL)
    assert 0 < kept.count() < before.count() and {"doc_id", "taken"} <= set(kept.columns)
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.matches(kept, benchmark).where("contaminated").count() == 0


def test_line_dedup_keeps_own_lines_of_a_repeated_doc_id(spark):
    shared = "\n".join(f"shared line {i} of a passage" for i in range(12))
    own = "\n".join(f"own line {i} only here" for i in range(12))
    rows = [(1, shared), (1, own), (2, shared), (3, "x\n" + own + "\ny"), (None, shared), (4, None), (4, "")]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_repeated(table(spark, rows)).collect()]
    assert (1, own, 0) in got
    assert any(d == 2 and removed > 0 for d, _, removed in got)
    assert (None, shared, 0) in got and (4, None, 0) in got and (4, "", 0) in got
    clash = table(spark, [(1, shared, 7), (2, shared, 8)], "doc_id long, text string, __ld_text int")
    assert sorted(r["__ld_text"] for r in line_dedup.remove_repeated(clash).collect()) == [7, 8]
