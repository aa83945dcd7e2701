"""Mixing, ranked search, the conversation trie and the ring against plain models, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from samerow.llm import curriculum, prefix_trie, ranked_search, sharding
from tests.llm.brute import WORD

SCHEDULES = (((0, 7.5), (1, 2.5)), ((0, 2), (1, 2)), ((0, 0.5), (1, 1.5)))
DOCS = "doc_id bigint, text string, source string, row string, size string, n string, at string"


def documents(spark, rows):
    """Rows of ``(doc_id, text, source)`` with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS).repartition(5)


# ---- mixing ---------------------------------------------------------------------------------------------


def shares(sizes, weights, repeats=3):
    """Targets by sharing again and again until no source is above its limit."""
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        rest = total - sum(held.values())
        all_weights = sum(weights[s] for s in free)
        found = {s: rest * weights[s] / all_weights for s in free} if all_weights else {}
        above = [s for s in free if found[s] > repeats * sizes[s]]
        if not above:
            return held | found
        held |= {s: repeats * sizes[s] for s in above}


def mixed(spark, rows, schedules=SCHEDULES, **options):
    found, order = curriculum.mix(documents(spark, rows), schedules, **options)
    return found.collect(), order.collect()


def source_weights(rows):
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}


def test_targets_and_words_taken(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40]), rnd.choice(["a", "b", "c", "d", "é", None, "hot", "hot", "hot"])) for i in range(400)]
    rows += [(400, "w " * 9000, "a"), (401, None, "c"), (402, " \n\t", None), (403, "x y z", "lonely")]
    found, order = mixed(spark, rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    wanted = shares(sizes, source_weights(rows))
    source = {i: s for i, _, s in rows}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    taken = defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert math.isclose(r["target"], wanted[s], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] > 0) == (r["n_copies"] > 0)
        taken[s] += r["taken"]
    assert sorted(r["doc_id"] for r in found) == sorted(source)
    assert all(taken[s] == math.floor(wanted[s] + 1e-9) or abs(taken[s] - wanted[s]) < 1 for s in sizes)
    assert sorted(r["place"] for r in order) == list(range(len(order)))
    times = [r["time"] for r in sorted(order, key=lambda r: r["place"])]
    assert times == sorted(times) and 0 < times[0] and times[-1] < 1
    by_doc = defaultdict(int)
    for r in order:
        by_doc[r["doc_id"]] += r["words"]
    assert by_doc == {r["doc_id"]: r["taken"] for r in found if r["taken"]}
    assert {r["copy"] for r in order} <= {0, 1, 2}


def test_delivery_follows_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    found, order = mixed(spark, rows)
    targets = {r["doc_id"] % 3: r["target"] for r in found}
    for k, schedule in enumerate(SCHEDULES):
        (_, w0), (_, w1) = schedule
        for t in (0.1, 0.5, 0.9):
            due = (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            delivered = sum(r["words"] for r in order if r["doc_id"] % 3 == k and r["time"] <= t)
            assert abs(delivered - due * targets[k]) <= 10


def test_schedules_of_several_pieces(spark):
    late = ((0, 0), (0.5, 0), (0.75, 4), (1, 0))
    never = ((0, 0), (1, 0))
    rows = [(i, "w " * 4, "ab"[i % 2]) for i in range(200)]
    found, order = mixed(spark, rows, schedules=(late, never), max_repeats=5)
    assert {r["target"] for r in found if r["doc_id"] % 2} == {0.0}
    assert {r["doc_id"] % 2 for r in order} == {0} and all(0.5 < r["time"] < 1 for r in order)
    assert sum(r["words"] for r in order) == 800 and sum(r["time"] < 0.75 for r in order) == len(order) // 2
    for bad in [((0, 1),), ((0, 1), (0.5, 1)), ((0, 1), (0, 1), (1, 1)), ((0, -1), (1, 1))]:
        with pytest.raises(ValueError):
            curriculum.weight(bad)


def test_mix_does_not_depend_on_partitions_or_order(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([i, None, 7]), "w " * rnd.randrange(9), rnd.choice("abc")) for i in range(300)]
    wanted = None
    for seed, parts in ((1, 2), (2, 7)):
        random.Random(seed).shuffle(rows)
        found, _ = curriculum.mix(documents(spark, rows).repartition(parts), SCHEDULES)
        got = sorted(map(repr, (tuple(r)[1:] for r in found.collect())))
        assert wanted is None or got == wanted
        wanted = got


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == ([], [])
    found, order = mixed(spark, [(1, None, "a"), (2, "", None)])
    assert [(r["target"], r["taken"], r["first_place"]) for r in found] == [(0.0, 0, None)] * 2 and order == []


# ---- ranked search --------------------------------------------------------------------------------------

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranking(docs, text, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n_docs, n_terms = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    scored = []
    for i, c, n in held:
        m = 25 + (75 * n * n_docs) // n_terms
        score = 0
        for t in terms(text):
            if c[t]:
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
        if score > 0 and i is not None:
            scored.append((-score, i))
    return [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]


def ask(spark, docs, items, k=10, **options):
    questions = spark.createDataFrame(items, "item_id bigint, text string")
    found = ranked_search.rank_documents(documents(spark, [(i, t, "s") for i, t in docs]), questions, k, **options).collect()
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return out


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ähre", "ähre", "ÄHRE", "x_y", "42"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 20, 80])))) for i in range(n)]
    items = [(q, " ".join(rnd.choices(words, k=rnd.choice([1, 4, 15])))) for q in range(12)]
    return docs, items


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_equals_scoring_everything(spark, k):
    docs, items = corpus(k)
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # more equal texts than are asked for
    found = ask(spark, docs, items, k)
    for item, text in items:
        assert found[item] == ranking(docs, text, k)


def test_search_without_spark_splits_intervals():
    rnd = np.random.default_rng(3)
    n, n_terms = 4000, 30
    row, term = np.nonzero(rnd.random((n, n_terms)) < 0.2)
    impact = rnd.integers(1, 1000, len(row))
    # One clear answer: everything else can be given up early.
    impact[row == 17] = 100_000
    postings = ranked_search.Postings(row, term, impact, n)
    asked, times = np.array([3, 4, 5, 8]), np.array([1, 2, 1, 1])
    best = ranked_search.Best(1)
    scored = ranked_search.search(postings, np.arange(n), asked, times, best)
    total = np.zeros(n, np.int64)
    for t, k in zip(asked, times):
        np.add.at(total, row[term == t], k * impact[term == t])
    assert (best.score[0], best.doc[0]) == (total.max(), total.argmax()) and scored < n // 10
    for k in (5, 50):
        best = ranked_search.Best(k)
        ranked_search.search(postings, np.arange(n), asked, times, best)
        order = np.lexsort((np.arange(n), -total))[:k]
        assert best.doc.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()


def test_search_over_many_small_slices(monkeypatch):
    """What a task does, with slices of few postings and few lookups at once, so that all borders occur."""
    import pyarrow as pa

    monkeypatch.setattr(ranked_search, "SLICE_POSTINGS", 60)
    monkeypatch.setattr(ranked_search, "LOOKUPS", 8)
    docs, items = corpus(5)
    docs += [(2000 + i, docs[11][1]) for i in range(30)]
    block = ranked_search._block([i for i, _ in items], [t for _, t in items])
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    df = Counter(t for _, c, _ in held for t in c)
    n = len(held)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in block.numbers])
    counts = ranked_search.Counts(n, sum(x[2] for x in held), weights)
    lists = [[(block.numbers[t], k) for t, k in c.items() if t in block.numbers] for _, c, _ in held]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in held], pa.int64()),
            pa.array([m for _, _, m in held], pa.int64()),
            pa.array([[t for t, _ in x] for x in lists], pa.list_(pa.int32())),
            pa.array([[k for _, k in x] for x in lists], pa.list_(pa.int32())),
        ],
        ["doc_id", "n", "terms", "counts"],
    )
    parts = list(ranked_search._bounded(batch))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == n
    best = [ranked_search.Best(10) for _ in items]
    for p in parts:
        doc, postings = ranked_search._inverted(p, counts, 10)
        for q, found in enumerate(best):
            ranked_search.search(postings, doc, block.terms[q], block.times[q], found)
    for found, (_, text) in zip(best, items):
        assert list(zip(range(1, 11), found.doc.tolist(), found.score.tolist())) == ranking(docs, text)


def test_range_maximum_table():
    rnd = np.random.default_rng(1)
    impact = rnd.integers(0, 50, 200)
    postings = ranked_search.Postings(np.arange(200) % 100, np.arange(200) // 100, impact, 100)
    for a in range(0, 100, 7):
        for b in range(a, 101, 9):
            place = int(postings.largest(np.array([a]), np.array([b]))[0])
            assert place == -1 if a == b else postings.impact[place] == impact[a:b].max() and a <= place < b


def test_search_in_blocks_and_edges(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha"), (3, None), (4, ""), (5, "..."), (6, "beta " * 5000), (7, "ALPHA,alpha;ALPHA")]
    items = [(10, "alpha"), (11, "beta beta alpha"), (12, None), (13, ""), (14, "gamma"), (11, "beta beta alpha"), (15, "Alpha")]
    whole, blocks = (ask(spark, docs, items, block_bytes=n) for n in (1 << 20, 8))
    assert whole == blocks
    for item in (10, 15):
        assert whole[item] == ranking(docs, "alpha")
    assert whole[11] == sorted(2 * ranking(docs, "beta beta alpha"))  # asked twice
    assert [d for _, d, _ in whole[10]] == [7, 1, 1] and not any(whole[i] for i in (12, 13, 14))
    for none in (ask(spark, [], items), ask(spark, docs, []), ask(spark, [(1, None)], items)):
        assert not any(none.values())


# ---- conversation trie ----------------------------------------------------------------------------------


def trie(paths):
    """Nodes of ``{conv: ((role, text), ...)}``, from the prefixes of all."""
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, convs in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            q = below.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * (len(q[-1][1]) if q else 0)
            below.extend(children[q])
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((convs[0], len(p), parent, len(convs), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn int, role string, text string, path string, key string, digest string, depth string"


def turn_table(spark, paths):
    rows = [(c, i, role, text, "x", "x", "x", "x") for c, turns in paths.items() for i, (role, text) in enumerate(turns)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(4)


def nodes(spark, paths, **options):
    found = prefix_trie.conversation_trie(prefix_trie.sequences(turn_table(spark, paths)), **options).collect()
    return sorted((tuple(r) for r in found), key=repr)


def conversations(seed, n=200):
    """Many conversations with common beginnings, some equal, a third of them one and the same, and a long one."""
    rnd = random.Random(seed)
    hot = (("user", "hello"), ("assistant", "hi"))
    out = {}
    for c in range(n):
        kind = rnd.random()
        base = () if kind < 0.2 else hot
        own = () if kind > 0.6 else tuple((rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "ccc", "é"])) for _ in range(rnd.randrange(1, 5)))
        out[c * 3] = base + own
    out[7] = tuple(("user", str(i % 3)) for i in range(500))
    return out


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 100_000])
def test_trie_equals_all_prefixes(spark, shard_turns):
    paths = conversations(shard_turns)
    assert nodes(spark, paths, shard_turns=shard_turns) == trie(paths)


def test_trie_in_many_partitions(spark, conf):
    conf(adaptive__coalescePartitions__enabled="false", shuffle__partitions="40")
    paths = conversations(11, 120)
    assert nodes(spark, paths, shard_turns=9) == trie(paths)


def test_trie_of_equal_and_nested_conversations(spark):
    a, b = ("user", "one"), ("assistant", "two")
    for paths in (
        {1: (a,)},
        {c: (a, b) for c in range(30)},
        {9: (a, b, a), 10: (a, b), 11: (a,), 8: (a, b), 100: (b,)},
        {5: (("", ""), ("", "")), 6: (("", ""),)},
        {1: (("ab", "c"),), 2: (("a", "bc"),)},  # roles and texts that read alike in a row
    ):
        for shard_turns in (1, 3, 1000):
            assert nodes(spark, paths, shard_turns=shard_turns) == trie(paths)


def test_trie_edges(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, "second"), (1, 0, "z", None), (None, 0, "user", "lost"), (2, None, "user", "first"), (2, None, "user", "first")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    found = prefix_trie.conversation_trie(prefix_trie.sequences(table)).collect()
    first = ("user", "first")
    assert sorted((tuple(r) for r in found), key=repr) == trie({1: (first, ("", "second"), ("z", "")), 2: (first, first)})
    assert prefix_trie.conversation_trie(prefix_trie.sequences(table.limit(0))).collect() == []


def test_conversations_without_turns_end_at_the_root(spark):
    schema = "conv_id bigint, turns array<struct<digest: string, length: bigint>>"
    for others in ([], [(4, [("ab" * 16, 3)])]):
        rows = [(c, []) for c in (10, 2, 33)] + others
        found = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema), shard_turns=1).collect()
        root = next(r for r in found if r["depth"] == 0)
        assert (root["conv_id"], root["n_convs"], root["n_leaves"]) == (2, 3 + len(others), 1)
        assert root["ends_sha256"] == hashlib.sha256(b"2,10,33").hexdigest() and root["parent_conv_id"] is None


def test_double_array_holds_every_child_and_no_other():
    rnd = random.Random(2)
    words = {tuple(rnd.choices(range(40), k=rnd.randrange(1, 6))) for _ in range(500)}
    prefixes = sorted({w[:d] for w in words for d in range(len(w) + 1)}, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(prefixes)}
    parent = np.array([number[p[:-1]] for p in prefixes])
    code = np.array([p[-1] if p else 0 for p in prefixes])
    packed = prefix_trie.DoubleArray(parent, code, 40)
    for p in prefixes:
        state = packed.state[number[p]]
        to = packed.step(np.full(40, state), np.arange(40))
        assert [int(x) if x >= 0 else None for x in to] == [
            int(packed.state[number[p + (c,)]]) if p + (c,) in number else None for c in range(40)
        ]


def test_rebuilt_conversations_of_the_query(spark, tmp_path):
    from samerow.llm.queries import queries

    rnd = random.Random(6)
    own = {c: tuple((rnd.choice(["user", "assistant"]), rnd.choice("abc")) for _ in range(rnd.randrange(1, 9))) for c in [*range(95, 320, 3), 100, 300]}
    rows = [(c, i, r, t) for c, turns in own.items() for i, (r, t) in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, ())[:h] + turns[h:]
    found = queries()["op13_double_array_trie"](spark, str(tmp_path))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == trie(rebuilt)


# ---- the ring -------------------------------------------------------------------------------------------


def walked(ids, n_shards, points, slots):
    """Shard of every id: row by row to the owner of its arc, then those that found no room on to the next arcs."""
    import xxhash

    nodes = sharding.ring(n_shards, points, slots)
    room = [len(ids) // n_shards + (s < len(ids) % n_shards) for s in range(n_shards)]

    def place(i):
        mixed = np.uint64(xxhash.xxh64_intdigest(np.int64(i).tobytes(), seed=42)).astype(np.int64)
        slot = int(mixed) % slots
        arc = next((k for k, (at, _) in enumerate(nodes) if at >= slot), 0)
        return arc, slot, int(mixed), i

    waiting, found = [], {}
    for arc, _, _, i in sorted(map(place, ids)):
        shard = nodes[arc][1]
        if room[shard]:
            room[shard] -= 1
            found[i] = shard
        else:
            waiting.append((arc, i))
    for arc, i in waiting:
        while not room[nodes[arc][1]]:
            arc = (arc + 1) % len(nodes)
        room[nodes[arc][1]] -= 1
        found[i] = nodes[arc][1]
    return found


@pytest.mark.parametrize("n_shards, points", [(1, 3), (5, 4), (24, 16)])
def test_ring_equals_walking_row_by_row(spark, n_shards, points):
    ids = random.Random(n_shards).sample(range(10_000), 700)
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").repartition(3)
    found = sharding.shard(frame, n_shards, points=points, slots=1 << 12).collect()
    assert {r["doc_id"]: r["shard"] for r in found} == walked(ids, n_shards, points, 1 << 12)
    for s in range(n_shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
