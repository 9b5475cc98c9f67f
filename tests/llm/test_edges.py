"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import components, decontaminate, license_scan, maxent_lm, packing, quality_rules, sharding, simhash_dedup, token_store, tool_calls, url_filter
from tokenizers import Tokenizer

from eventloom.llm.encoder import Encoder, resolve
from eventloom.llm.perfect_hash import PerfectHash, packed, unpacked
from eventloom.sources import scratch
from frames import LICENSED, PROSE, documents, key, texts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    scratch.prepare(spark)
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "Two words"), (1, PROSE)], "item_id long, text string")


def ids_of(df):
    return sorted((r.doc_id for r in df.collect()), key=key)


ALL = sorted((k for k, _ in texts()), key=key)


def test_op1(docs, none):
    got = license_scan.scan(docs).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(12, "Apache-2.0 notice", 1.0)]
    assert LICENSED[got[0].start : got[0].end] == "Licensed under the Apache License, Version 2.0"
    assert license_scan.scan(none).count() == 0


def test_op1_finds_a_changed_text():
    index = license_scan.Index(tuple(sorted(license_scan.TEMPLATES.items())))
    words = license_scan.TEMPLATES["MIT"].split()
    del words[40:43]
    words.insert(20, "really")
    words[60] = "other"
    hit = index.scan(("Intro words here. " + " ".join(words) + " The end.").encode())
    assert [h[0] for h in hit] == ["MIT"] and hit[0][1] > 0.95 and hit[0][4] == 3
    assert index.scan(b"permission is granted to nobody") == []


def test_op1_a_text_of_many_notices():
    """Each of them is found, at its place in characters, in time that follows the text."""
    index = license_scan.Index(tuple(sorted(license_scan.TEMPLATES.items())))
    line = "é Licensed under CC BY-NC 4.0. Ünder words between the notices go on and on.\n"
    got = index.scan((line * 3000).encode())
    assert [(r[0], r[6], r[7]) for r in got] == [("CC-BY-NC-4.0 notice", k * len(line) + 2, k * len(line) + 29) for k in range(3000)]


def test_op1_short_notices_line_after_line():
    index = license_scan.Index((("short", "Released under the MIT License"),))
    hits = index.scan(b"Released under the MIT License.\n" * 30)
    assert [(h[1], h[4], h[5]) for h in hits] == [(1.0, 5 * k, 5 * k + 4) for k in range(30)]


def test_op1_a_text_split_by_an_insertion():
    index = license_scan.Index((("long", " ".join(f"w{k}" for k in range(100))), ("short", "Released under the MIT License")))
    words = [f"w{k}" for k in range(100)]
    inside = ["footer"] * 30 + "Released under the MIT License".split() + ["page"] * 30
    hits = index.scan(" ".join(words[:50] + inside + words[50:]).encode())
    assert [h[:6] for h in hits] == [("long", 1.0, 100, 100, 0, 164), ("short", 1.0, 5, 5, 80, 84)]
    assert index.scan(" ".join(words[50:] + inside[:30] + words[:50]).encode()) == []


def test_op1_winnowing_meets_every_shared_run():
    rng = np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 50, 40).astype(np.uint64)
        places = set(license_scan.winnow(h).tolist())
        assert all(places & set(range(k, k + license_scan.WINDOW)) for k in range(len(h) - license_scan.WINDOW + 1))


def test_op2(spark, docs, none):
    directory = token_store.write_store(docs, scratch.new_path(spark, "store"), WORD, 1)
    got = token_store.read_all(directory).orderBy("start").collect()
    assert sorted((r.key for r in got), key=key) == ALL
    assert [r.key for r in got] == sorted((r.key for r in got), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    keys = spark.createDataFrame([(1,), (9,), (777,), (2**62,), (-5,)], "key long")
    back = token_store.read_keys(token_store.route(keys, directory)).collect()
    assert sorted(r.key for r in back) == [1, 1, 9, 2**62]
    want = {zlib.crc32(x + b"\1\0\0\0") for x in Encoder(resolve(WORD)).encode([PROSE])}
    assert {r.ids_crc32 for r in back if r.key == 1} == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in back)
    empty = token_store.write_store(none, scratch.new_path(spark, "store"), WORD, 1)
    assert token_store.read_all(empty).count() == 0 and token_store.route(keys, empty).count() == 0


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        table = PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        foreign = rng.integers(2**63, 2**64, 1000, dtype=np.uint64)
        assert (table.slots(foreign) == -1).all()
        arrays, head = unpacked(packed(table.arrays(), kind="<u2"))
        assert head == {"kind": "<u2"} and (PerfectHash(**arrays).slots(keys) == table.slots(keys)).all()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def test_op3(spark, docs, none, tmp_path):
    got = sharding.interleave(docs, 4).collect()
    assert ids_of(sharding.interleave(docs, 4)) == ALL
    sizes = [sum(r.shard == k for r in got) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id in (4, 5)} == {(16, 0)}
    assert sharding.interleave(none, 4).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert ids_of(back) == ALL and set(back.columns) == {*docs.columns, "shard", "slot"}
    assert back.select("shard", "slot").distinct().count() == len(ALL)
    import pytest

    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Slot", F.lit(1)), str(tmp_path / "t"), 4)


def test_op2_a_hot_key_spans_shards_and_null_keys_are_found(spark):
    hot = spark.range(400).select(F.lit(50).cast("long").alias("doc_id"), F.concat(F.lit("row "), (F.col("id") % 350).cast("string")).alias("text"))
    rest = spark.createDataFrame([(None, "x <|endoftext|> y"), (None, None), (7, "seven"), (49, "before"), (51, "after")], "doc_id long, text string")
    directory = token_store.write_store(hot.unionByName(rest), scratch.new_path(spark, "store"), WORD, 1, shard_bytes=300)
    assert directory.where("key = 50").select("base").distinct().count() > 3
    keys = spark.createDataFrame([(None,), (7,), (50,), (52,), (-5,)], "key long")
    got = token_store.read_keys(token_store.route(keys, directory)).groupBy("key").count().collect()
    assert {(r.key, r["count"]) for r in got} == {(None, 2), (7, 1), (50, 400)}
    back = token_store.read_all(directory).orderBy("start").collect()
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1].tolist()] and len(back) == 405


def test_op4(docs, none):
    got = quality_rules.judge(docs)
    assert ids_of(got) == ALL
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].base_failed and by[5].n_words == by[6].n_words == 0 and not by[11].kept and by[1].kept
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and ids_of(kept) == sorted((r.doc_id for r in got.collect() if r.kept), key=key)
    assert quality_rules.keep_good(none).count() == 0


def test_op4_weights_come_from_the_votes():
    votes = {"+++++++++": 900, "-++++++++"[::-1]: 5, "+-++-++++": 80}
    fit = quality_rules.fit(votes)
    assert fit.patterns["+++++++++"] > 0.99 and fit.patterns["+-++-++++"] < 0.5
    assert quality_rules.fit({}).posterior("+" * 9) > 0.9


def test_op5(docs, none):
    got = packing.pack(docs, BYTE, 64, 0, with_ids=True, keep=["lang", "size"]).toPandas()
    assert len(got[["lang", "size"]].drop_duplicates()) == 1
    assert sorted(got[got.piece == 0].doc_id.fillna(-1)) == sorted(-1 if k is None else k for k in ALL)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 64
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(got.ids, got.ids_crc32, got.length))
    assert packing.pack(none, BYTE, 64, 0).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_op5_plans(given_):
    capacity, items = given_
    plan = packing.plan({s: items.count(s) for s in set(items)}, capacity)
    starts = (plan.length << 40) + plan.rank
    bins = {}
    for s in set(items):
        for r in range(items.count(s)):
            k = int(np.searchsorted(starts, (s << 40) + r, "right")) - 1
            nth = r - int(plan.rank[k])
            bins.setdefault(int(plan.base[k]) + nth // int(plan.each[k]), []).append((int(plan.offset[k]) + nth % int(plan.each[k]) * s, s))
    assert sorted(bins) == list(range(plan.sequences))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(s for _, s in b[:k]) for k in range(len(b))] and sum(s for _, s in b) <= capacity
        assert sum(3 * s > capacity for _, s in b) <= 2


def test_op6(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "https://a.net"), (3, "no scheme/x"), (4, "HTTP://WWW.Example.NET/en/" + "x" * 5000), (5, "x://h?q://z"), (6, "https://a.example.com/de/1#f"), (7, "a://b.ORG/fr/é?x")]
    pages = spark.createDataFrame([(k, u, "v", "v") for k, u in rows], "page_id long, url string, host string, label string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.labelled(spark)).collect()}
    assert (got[1].host, got[1].path, got[2].host) == ("", "", "") and got[3].host == ""
    assert got[None].host == "a.net" and got[None]["rule"] is None
    assert (got[4]["rule"], got[4].verdict) == ("example.net/en/", "allow") and (got[5].host, got[5].path) == ("h", "")
    assert (got[6]["rule"], got[7]["rule"], got[7].path) == ("example.com/de/", "org/fr/", "/fr/é")
    assert url_filter.judge(pages.limit(0), url_filter.labelled(spark)).count() == 0
    one = url_filter.labelled(spark).where("blocked")
    assert {r.verdict for r in url_filter.judge(pages, one, rules=()).collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge(pages, one.limit(0), rules=()).collect()} == {"allow"}


def test_op7(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, "f", '{"x": 1, "q":"s"}', None, 0), (1, "b", 3, "f", '{"x":"no"}', ["a"], 0), (1, "b", 4, "f", '{"x":2}', None, 0), (2, "p", 5, "f", '{"x":5}', ["q"], 0), (2, "q", 6, "g", "[1]", [], 0),
         (3, "c", 1, "f", '{"x":5}', ["d"], 0), (3, "d", 2, "f", "{}", ["c"], 0), (None, "n", 1, "f", '{"x":7,"z":1}', None, 0), (4, None, 1, None, None, None, 0)],
        "conv long, call_id string, position long, tool string, arguments string, after array<string>, extra int",
    )
    results = spark.createDataFrame([(1, "a", 2, "ra"), (1, "a", 5, "again"), (1, "zz", 6, "orphan"), (2, "p", 4, "early"), (2, "q", 9, 'q\n"x'), (2, "q", 9, 'q\n"x'), (None, "a", 1, None)], "conv long, call_id string, position long, content string")
    schemas = {"f": {"properties": {"x": {"type": "integer", "minimum": 2}, "q": {"type": "string"}}, "required": ["x"], "additionalProperties": False}, "g": {}}
    got = tool_calls.link(calls, results, schemas).collect()
    status = sorted((r.conv or 0, r.call_id or "", r.status) for r in got)
    assert status == sorted([
        (1, "a", "linked"), (1, "a", "duplicate_result"), (1, "b", "unanswered"), (1, "b", "duplicate_call"), (1, "zz", "orphan"), (2, "p", "early"), (2, "q", "linked"), (2, "q", "duplicate_result"),
        (3, "c", "cyclic"), (3, "d", "cyclic"), (0, "n", "unanswered"), (4, "", "unanswered"), (0, "a", "orphan"),
    ])
    of = {(r.conv, r.call_id, r.status): r for r in got}
    assert of[2, "q", "linked"].place == 0 and of[2, "p", "early"].place == 1
    assert of[1, "a", "linked"].canonical == '{"arguments":{"q":"s","x":1},"id":"a","name":"f","result":"ra"}'
    assert of[2, "q", "linked"].canonical.endswith('"result":"q\\n\\"x"}')
    assert of[1, "a", "linked"].errors == ["x: minimum"] and of[1, "b", "unanswered"].errors == ["x: type"] and of[3, "d", "cyclic"].errors == ["x: missing"]
    assert of[None, "n", "unanswered"].errors == ["z: unknown"] and of[2, "q", "linked"].errors == ["not a JSON object"]
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_op7_a_late_chain_is_no_cycle(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "_ROUNDS", 2, raising=False)
    names = "abcdef"
    rows = [(1, c, 10 - k, "f", "{}", [names[k - 1]] if k else []) for k, c in enumerate(names)]
    calls = spark.createDataFrame(rows, "conv long, call_id string, position long, tool string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv long, call_id string, position long, content string")
    got = tool_calls.link(calls, results, {"f": {}}).collect()
    assert sorted((r.call_id, r.status, r.place) for r in got) == [(c, "unanswered", k) for k, c in enumerate(names)]
    assert tool_calls.link(calls, results, {"f": {}}, most_levels=6).where("place is not null").count() == 6
    with pytest.raises(RuntimeError, match="levels"):
        tool_calls.link(calls, results, {"f": {}}, most_levels=5)


def test_op7_messages(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"u","name":"f","arguments":{"b":3,"a":[1, 2]},"after":["k"]},{"id":"k","name":"f","arguments":{}}]}'), (1, 1, "tool", '{"tool_call_id":"u","content":"done"}'), (1, 2, "user", "hi"), (1, 3, "assistant", None), (None, None, None, "{}")]
    calls, results = tool_calls.from_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.call_id, r.arguments, r.after) for r in calls.orderBy(F.desc("call_id")).collect()] == [("u", '{"a":[1,2],"b":3}', ["k"]), ("k", "{}", None)]
    assert [tuple(r) for r in results.collect()] == [(1, "u", 1, "done")]
    linked = tool_calls.link(calls, results, {})
    assert {(r.call_id, r.status, r.place) for r in linked.collect()} == {("u", "linked", 1), ("k", "unanswered", 0)}


def test_op8(docs, none, bench):
    got = decontaminate.contaminated(docs, bench)
    hits = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(1, 1), (2, 1), (3, 1), (12, 1), (13, 1), (2**62, 1), (8, 4)} == hits
    assert all(r.similarity == 1.0 for r in got.where("doc_id = 1").collect())
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and ids_of(clean) == sorted((k for k in ALL if k not in {d for d, _ in hits}), key=key)
    assert decontaminate.keep_clean(none, bench).count() == 0 and decontaminate.keep_clean(docs, bench.where("text is null")).count() == len(ALL)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_op8_passes_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(80)]
    common = " ".join(words[:7])
    items = [" ".join(words[j] for j in rng.integers(0, 80, n)) + " " + common for n in rng.integers(5, 30, 40)]
    texts_ = [f"{items[k]} and {items[(k * 7 + 1) % 40]} {common}" for k in range(40)] + [" ".join(items[3].split()[:-2] + ["x", "y"])]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (99, items[0].upper() + ".")], "item_id long, text string")
    find = lambda: {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in decontaminate.contaminated(docs, bench).collect()}
    one = find()
    assert len(decontaminate.Passes(bench, "item_id", "text").plan) == 1 and len(one) > 80 and (0, 99) in one
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 900)
    plan = decontaminate.Passes(bench, "item_id", "text").plan
    assert len(plan) > 3 and find() == one
    monkeypatch.setattr(decontaminate, "MOST_SHARED", 1)
    import pytest

    with pytest.raises(ValueError):
        decontaminate.Passes(bench, "item_id", "text")


def test_op8_index_of_many_items_is_small_and_finds_them():
    rng = np.random.default_rng(9)
    words = [f"w{k}".encode() for k in range(5000)]
    items = tuple((k, tuple(words[j] for j in rng.integers(0, 5000, 10 + k % 40))) for k in range(5000))
    index = decontaminate.Index(items)
    assert sum(near.nbytes for _, _, near in index.of_size.values()) < 300 * len(items)
    for k in range(0, 5000, 250):
        changed = list(items[k][1]) if len(items[k][1]) < 30 else [*items[k][1][:-1], b"other"]
        assert k in {n for n, *_ in index.search(b" ".join([b"a b c", *changed, b"d"]))}


def test_op8_index_misses_nothing_in_its_radius():
    rng = np.random.default_rng(2)
    words = [f"w{k}".encode() for k in range(400)]
    items = tuple((k, tuple(words[j] for j in rng.integers(0, 400, 20))) for k in range(60))
    index = decontaminate.Index(items)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in rng.integers(1, 24, 60)]
    prints = index.prints ^ np.array(flips, np.uint64)
    at, item = index.within(prints, 20)
    near = {(a, b) for a in range(60) for b in range(60) if np.bitwise_count(prints[a] ^ index.prints[b]) <= decontaminate.RADIUS}
    assert set(zip(at.tolist(), item.tolist())) == near and all((k, k) in near for k in range(60))


def test_op9(docs, none):
    got = simhash_dedup.near_duplicates(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert ids_of(got) == ALL
    assert by[4] == by[5] == by[6] == {("0" * 16, 4)} and ("0" * 16, 4) in by[None]
    assert {c for _, c in by[1] | by[2] | by[2**62]} == {1}
    assert sorted(map(str, simhash_dedup.near_duplicates(docs, groups=8).collect())) == sorted(map(str, got.collect()))
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_one(docs)
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: key(r[0]))
    sets = [simhash_dedup.shingle_set((t or "").encode(), 5) for _, t in rows]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if simhash_dedup.similarity(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    got = [r.doc_id for r in kept.collect()]
    assert got.count(1) == 1 and not {2, 3, 13, 2**62, 5, 6} & set(got) and simhash_dedup.keep_one(none).count() == 0


def test_op9_copies_of_one_text_find_it_in_a_large_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        own = list(base)
        for at in rng.choice(200, 3, replace=False):
            own[at] = f"x{k}-{at}"
        rows.append((k, " ".join(own)))
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def test_op9_no_pair_at_the_threshold_is_left_out(spark):
    """3000 pairs of texts of 40 and 50 shingles, 40 of them in common; least hashes as candidates left some out."""
    rows = []
    for k in range(3000):
        rows.append((2 * k, " ".join(f"p{k}w{i}" for i in range(44))))
        rows.append((2 * k + 1, " ".join(f"p{k}w{i}" for i in range(54))))
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 6000, 2))


def test_op9_texts_that_are_alike_to_some_of_their_group_only(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = [f"c{c}w{i}" for i in range(150)]
        for _ in range(25):
            own = list(base)
            for at in rng.choice(150, rng.integers(1, 6), replace=False):
                own[at] = f"x{rng.integers(40)}"
            rows.append((len(rows), " ".join(own)))
    sets = [simhash_dedup.shingle_set(t.encode(), 5) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and simhash_dedup.similarity(sets[i], sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_op9_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in rng.integers(0, 9, 2000) if n >= 0 for n in [max(1, n)]], np.uint64)
    b = a ^ flips
    exact = np.bitwise_count(a ^ b)
    bound = np.bitwise_count(simhash_dedup._counts_code(a) ^ simhash_dedup._counts_code(b))
    assert (bound <= exact).all()
    for groups, many in ((4, 4), (6, 20), (8, 56)):
        masks = [np.uint64(m % 2**64) for m in simhash_dedup.masks(groups)]
        meet = np.any([(simhash_dedup._counts_code(a) & m) == (simhash_dedup._counts_code(b) & m) for m in masks], axis=0)
        assert len(masks) == many and meet[exact <= 3].all()
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)[:50]], "code long").select("code", simhash_dedup.counts_code(F.col("code")).alias("e"))
    assert all(int(simhash_dedup._counts_code(np.array([r.code], np.int64).view(np.uint64))[0]) == r.e % 2**64 for r in df.collect())


def test_op9_large_cells_go_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 3), replace=False)) for b in base for _ in range(120)]
    codes = sorted({*near, *(int(x) for x in rng.integers(0, 2**64, 50, dtype=np.uint64))})
    rows = [(simhash_dedup._signed(c), k) for k, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "code long, least long")
    cells = np.array([[t, simhash_dedup._signed(int(simhash_dedup._counts_code(np.array([c], np.uint64))[0]) & (m % 2**64)), simhash_dedup._signed(c)] for c in codes for t, m in enumerate(simhash_dedup.masks())], np.int64)
    import pandas as pd

    frame = pd.DataFrame(cells, columns=["table", "cell", "a"]).sort_values(["table", "cell"])
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    parts = [frame.iloc[k : k + 700] for k in range(0, len(frame), 700)]
    found = pd.concat(simhash_dedup._in_cells(iter(parts)))
    large = found[found.block >= 0]
    assert len(large)
    edges = found[found.block < 0][["a", "b"]]
    many = large.groupby(["table", "cell"]).block.max()
    pairs = [(t, c, min(i, j), max(i, j), a) for t, c, i, a in large[["table", "cell", "block", "a"]].itertuples(index=False) for j in range(many[t, c] + 1)]
    between = pd.concat(simhash_dedup._between_blocks(iter([pd.DataFrame(sorted(pairs), columns=["table", "cell", "i", "j", "a"])])))
    edges = pd.concat([edges, between[["a", "b"]]]).drop_duplicates()
    parent = {simhash_dedup._signed(c): simhash_dedup._signed(c) for c in codes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges.itertuples(index=False):
        assert ((a ^ b) % 2**64).bit_count() <= 3
        parent[root(b)] = root(a)
    a = np.array(codes, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            assert root(simhash_dedup._signed(codes[i])) == root(simhash_dedup._signed(codes[j]))
    assert simhash_dedup.classes(df, "least").select("class_least").distinct().count() == len({root(simhash_dedup._signed(c)) for c in codes})


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1200))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op10(docs, none):
    got = maxent_lm.score(docs, settings=maxent_lm.Settings(frequent=50)).collect()
    assert sorted((r.doc_id for r in got), key=key) == ALL
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5, 6)) and all(np.isfinite(r.score) and r.score < 0 for r in got)
    whole = {r.doc_id: r for r in maxent_lm.score(docs).collect()}
    assert all(abs(r.base_score - whole[r.doc_id].base_score) < 1e-6 and r.n_known == whole[r.doc_id].n_known for r in got if r.doc_id is not None)
    assert maxent_lm.score(none).count() == 0
    untrained = maxent_lm.score(documents_of_remainder_one(docs)).collect()
    assert untrained and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in untrained)


def documents_of_remainder_one(docs):
    keys = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1][:3]
    return docs.where("doc_id = 1").limit(1).withColumn("doc_id", F.explode(F.array(*[F.lit(k).cast("long") for k in keys])))


def test_op10_changes_of_any_number_of_tasks_are_summed(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FAN_IN", 3)
    made = [(k % 2, 0, salt, 10 + salt, np.full(4, salt + k % 2, np.float32).tobytes()) for salt in range(20) for k in range(2)]
    at, tasks = spark.createDataFrame(made, maxent_lm._BLOCKS), 20
    while tasks > 1:
        at, tasks = maxent_lm._summed(at), -(-tasks // 3)
    got = {r["kind"]: (r["tokens"], np.frombuffer(r["sums"], np.float32).tolist()) for r in at.collect()}
    assert got == {0: (390, [190.0] * 4), 1: (390, [210.0] * 4)}


def test_op10_probabilities_sum_to_one():
    s = maxent_lm.Settings(frequent=100, classes=2, members=4, tails=3, pairs=16, inner=32)
    rows = [(w, c) for w, c in zip("the of and to in a is it xx yy zz qq".split(), range(40, 28, -1))] + [(maxent_lm.END, 9)]
    own = {w for w, _ in maxent_lm.Lexicon.best(rows, s)}
    tails = {}
    for w, c in rows:
        if w not in own:
            t = tails.setdefault(maxent_lm.tail_of(w, 3), [0, 0])
            t[0] += c
            t[1] += 1
    lexicon = maxent_lm.Lexicon(s, rows, sum(c for _, c in rows), len(rows), tails)
    rng = np.random.default_rng(5)
    model = maxent_lm.Model(lexicon, tuple(rng.normal(size=x).astype(np.float32) for x in s.shapes()))
    places = np.arange(s.own + s.tails)
    features = np.repeat(np.array([[1], [s.contexts + 2], [2 * s.contexts + 5]]), len(places), 1)
    real = len(own)
    p = np.exp(model.run(places, features))
    total = p[:real].sum() + sum(p[s.own + t] * ((lexicon.tail_total[t] + 0.5 * lexicon.tail_distinct[t] + 0.5) / (lexicon.tail_total[t] + 0.5 * (lexicon.tail_distinct[t] + 1))) for t in range(3))
    assert abs(total - 1) < 1e-5


def test_op10_every_round_trains_every_feature():
    import pyarrow as pa

    s = maxent_lm.Settings(frequent=100, classes=2, members=4, tails=3, pairs=16, inner=32)
    rows = [(w, c) for w, c in zip("the of and to in a is it".split(), range(40, 32, -1))] + [(maxent_lm.END, 9)]
    lexicon = maxent_lm.Lexicon(s, rows, sum(c for _, c in rows), len(rows), {maxent_lm.tail_of(maxent_lm.END, 3): (9, 1)})
    model = maxent_lm.Model(lexicon, tuple(np.zeros(x, np.float32) for x in s.shapes()))
    model.learn()
    _, _, _, _, at, features = model.batch(pa.array(["the of and to in a is it the of"]))
    before = model.run(at, features).sum()
    for expected, met in zip(model.expected, model.met):
        assert np.allclose(expected.sum(1), met.sum(1), atol=1e-4) and met.sum() in (3 * len(at), 3 * int((at < s.own).sum()))
    model.weights = tuple(maxent_lm.updated(w, e, m, s.shy) for w, e, m in zip(model.weights, model.expected, model.met))
    for rows in features:
        assert model.weights[0][rows].any(1).all()
    own = at < s.own
    hashed = maxent_lm._mix(features[:, own] * s.classes + at[own] // s.members, s.inner)
    assert model.weights[1][hashed].any(2).all()
    assert model.run(at, features).sum() > before


def test_op10_scores_dont_depend_on_partitions_and_equal_one_process(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    s = maxent_lm.Settings(frequent=1 << 20, rounds=2)
    one, many = ({r.doc_id: r.score for r in maxent_lm.score(docs.repartition(n), settings=s).collect()} for n in (1, 9))
    rows = docs.withColumn("train", ~maxent_lm.held_out(F.col("doc_id"))).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)))
    lexicon = maxent_lm.lexicon_of(maxent_lm.count_words(rows, s), s)
    weights = [np.zeros(x, np.float32) for x in lexicon.settings.shapes()]
    data = rows.toPandas()
    for k in range(2):
        model = maxent_lm.Model(lexicon, weights)
        model.learn()
        _, _, _, _, at, features = model.batch(pa.array(data.text[data.train & (data.group == k)].tolist()))
        model.run(at, features)
        weights = [maxent_lm.updated(*x, s.shy) for x in zip(weights, model.expected, model.met)]
    model = maxent_lm.Model(lexicon, weights)
    for d, text in zip(data.doc_id, data.text):
        assert abs(one[d] - many[d]) <= 1e-3 * abs(one[d]) + 1e-3
        bounds, names, number, stream, at, features = model.batch(pa.array([text]))
        logs = model.run(at, features) / np.log(10)
        known = number[stream] >= 0
        count = np.where(known, lexicon.count[number[stream]], 0.0)
        tail = at >= lexicon.settings.own
        logs[tail] += lexicon.in_tail(at[tail] - lexicon.settings.own, count[tail])
        assert abs(one[d] - logs.sum()) <= 1e-3 * abs(one[d]) + 1e-3


def test_op10_sizes_grow_with_the_corpus():
    small, large = (maxent_lm.Settings().sized(n) for n in (10**6, 10**9))
    assert large.pairs == 10 * small.pairs and large.inner == 10 * small.inner and large.classes > 3 * small.classes
    assert maxent_lm.Settings(pairs=7).sized(10**9).pairs == 7


def test_encoder_matches_the_tokenizer():
    import random

    random.seed(0)
    letters = list("ab .,'\n !-\"é1|$") + ["'s", "  ", "\n\n", "the", "Thé", "\t", "'", "&&&", "\r\n", "İ", "Σ", "don't", "中", "\x01", "\u00a0"]
    letters += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    rows = ["", " ", "\n", "\n\n", "a\n\n\nb", "<|endoftext|> x", "x <|endoftext|> y", "x<|endoftext|>", *("".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(3000)), *(t or "" for _, t in texts())]
    for name in (WORD, BYTE):
        e = Encoder(resolve(name), kept=500)
        want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(resolve(name)).encode_batch(rows, add_special_tokens=False)]
        assert e.encode(rows) == want and e.encode(rows) == want


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert scratch.shared_folder(spark).startswith("file:")
