import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import base, exact_dedup, ngram_join, token_counts
from tidemill.llm.base import Scratch, keep_or_drop
from tidemill.llm.components import connected_components


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, keep_id long, kept string")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=4000), st.binary(max_size=4000))
def test_chunks_depend_on_content_only(a, b):
    """The chunks of a text are the same wherever it stands, and join to the whole."""
    own = exact_dedup.chunk_ends(len(a), exact_dedup.cut_points(np.frombuffer(a, np.uint8)))
    assert own[-1] == len(a) and own == sorted(own) and all(z - s <= exact_dedup.MOST for s, z in zip([0, *own], own))
    both = exact_dedup.cut_points(np.frombuffer(b + a, np.uint8)) - len(b)
    assert own == exact_dedup.chunk_ends(len(a), both[both >= exact_dedup.LEAST])


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    rng = random.Random(4)
    long = "".join(rng.choice("abcde ") for _ in range(30_000))
    texts = [None, "", "Abc", "aBC", "abd", long, long.upper(), long[:-1] + "!", "É", "é", long[::-1], "", "abc"]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, list(enumerate(texts))), hash_bits=bits).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if low(u) == low(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(low(t).encode()).hexdigest())
    assert got[5].n_chunks > 3


def test_exact_duplicates_edges(spark):
    rows = [(None, "a"), (None, "a"), (3, "b"), (3, "B"), (2, "b")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.kept) for r in got if r.doc_id) == [(2, False), (3, True), (3, True)]
    assert exact_dedup.exact_duplicates(frame(spark, rows).limit(0)).count() == 0


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """doc_id -> smallest doc_id reachable, by comparing everything with everything."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def corpus(rng, n_groups, n_copies, length=120, changes=6):
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = []
    for g in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, length))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.randint(1, n_copies)):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 200), (2, 4), (3, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "SPREAD_SETS", 3 * block)
    rng = random.Random(seed)
    texts = [*corpus(rng, 25, 6), *corpus(rng, 1, 40, changes=20), None, "", " \t", "one two", "ONE TWO", "one two three", "a b c d e", "Été a b c d e f"]
    rows = list(enumerate(texts))
    got = ngram_join.similar_components(frame(spark, rows), block_sets=block).collect()
    want = components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_ngram_join_edges(spark):
    empty = frame(spark, []).limit(0)
    assert ngram_join.similar_components(empty).count() == 0
    only_empty = ngram_join.similar_components(frame(spark, [(1, None), (2, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in only_empty) == [(1, 0, 1), (2, 0, 2)]
    ties = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "A b c d e f")]
    got = ngram_join.similar_components(frame(spark, ties)).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.n_shingles} == {7}
    kept = ngram_join.keep_one_each(frame(spark, [(7, "a b c d e f"), (9, "A b c d e f"), (1, "z")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7] and kept.columns == ["doc_id", "text", "keep_id", "kept"]


def test_a_bridge_without_an_id(spark):
    """Texts that are linked only through one whose rows all have a null id."""
    w = [f"w{k}" for k in range(104)]
    texts = [(1, " ".join(w[:88])), (None, " ".join(w[:96])), (None, " ".join(w[:96])), (2, " ".join(w[8:104])), (None, "some other text of eight words in all"), (None, "and one more text of seven words")]
    texts[3] = (2, " ".join(w[:104]))
    texts[0] = (1, " ".join(w[20:96]))
    linked = lambda a, b: 100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(a) | shingles(b))
    assert linked(texts[0][1], texts[1][1]) and linked(texts[1][1], texts[3][1]) and not linked(texts[0][1], texts[3][1])
    got = ngram_join.similar_components(frame(spark, texts)).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, [(1, 1), (None, 1), (None, 1), (2, 1), (None, None), (None, None)]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=1, max_size=14))
def test_prefix_tree_overlaps(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    tree = ngram_join.PrefixTree(arrays)
    for row, a in zip(tree.overlaps(list(range(len(sets)))), sets, strict=True):
        for got, b in zip(row.tolist(), sets, strict=True):
            assert got == len(a & b) if 2 * len(a & b) >= len(a | b) else got in (-1, len(a & b))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=9), min_size=1, max_size=16), st.data())
def test_block_links_connect_what_links_connect(sets, data):
    n = len(sets)
    edges = [(i, j) for i, j in itertools.combinations(range(n), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    labels = data.draw(st.none() | st.lists(st.integers(0, 5), min_size=n, max_size=n))

    def classes(pairs):
        p = list(range(n))
        for a, b in [*pairs, *([(i, j) for i, j in itertools.combinations(range(n), 2) if labels[i] == labels[j]] if labels else [])]:
            p = [p[a] if x == p[b] else x for x in p]
        return [[x == y for y in p] for x in p]

    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = ngram_join.block_links(arrays, labels)
    assert classes(got) == classes(edges) and len(got) < n
    pivots = data.draw(st.lists(st.integers(0, n - 1), unique=True))
    got = ngram_join.block_links(arrays, labels, pivots)
    assert classes(got) == classes([e for e in edges if e[0] in pivots or e[1] in pivots])


def test_a_walk_gathers_by_pieces(monkeypatch):
    """Long sets that differ in many places: what a walk holds at once doesn't grow with their tokens by pivots."""
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    sets = [pool[rng.random(3000) < 0.8] for _ in range(200)]
    tree = ngram_join.PrefixTree(sets)
    monkeypatch.setattr(ngram_join, "WALK_CELLS", 600_000)
    tracemalloc.start()
    got = tree.overlaps(list(range(200)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    for i, j in rng.integers(0, 200, (50, 2)).tolist():
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


@pytest.mark.parametrize("seed", [4, 5])
def test_chunks_of_long_sets(spark, monkeypatch, seed):
    """A group of near copies whose sets are long for a chunk is dealt by its hashes, and no link is lost."""
    monkeypatch.setattr(ngram_join, "CHUNK_HASHES", 1500)
    rng, dealt, search = random.Random(seed), [], ngram_join._search

    def noted(rows, sets):
        held = rows.join(sets, "cid").groupBy("block", "part", "chunk", "pivot").agg(F.sum(F.octet_length("hashes") / 8).alias("h"), F.count(F.lit(1)).alias("n"))
        dealt.extend(held.collect())
        return search(rows, sets)

    monkeypatch.setattr(ngram_join, "_search", noted)
    texts = [*corpus(rng, 1, 1, length=300), *corpus(rng, 6, 5)]
    vocab = [f"v{k}" for k in range(900)]
    for _ in range(40):  # of one group, some of it linked only over others
        w = list(vocab)
        for _ in range(rng.randint(0, 40)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = ngram_join.similar_components(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows)
    assert max(r.h for r in dealt) < 9000 and sum(r.n for r in dealt) >= 40  # of 35,000 in one chunk


def test_needed_shares_of_sketches():
    """The chance that linked sets share fewer than NEEDED of their smallest hashes."""
    from math import comb

    k, c = ngram_join.SKETCH, ngram_join.NEEDED
    assert sum(comb(k, i) * 0.75**i * 0.25 ** (k - i) for i in range(c)) < 1e-15


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_few_rows_take_few_files(spark, monkeypatch):
    """Tables of which is known that they are small aren't dealt over as many files as there are shuffle partitions."""
    files, save = [], Scratch.save

    def noted(self, df, name, *rows):
        saved = save(self, df, name, *rows)
        files.append(len(saved.inputFiles()))
        return saved

    monkeypatch.setattr(Scratch, "save", noted)
    edges = Scratch(spark, "t").save(spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long"), "edges")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        files.clear()
        got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "t")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(101), 0) and files and set(files) == {1}
    monkeypatch.setattr(base, "TASK_ROWS", 30)
    work = Scratch(spark, "t")
    many = work.save(spark.range(0, 100, 1, 8), "many", 100)
    assert files[-1] == 4 and many.count() == 100
    assert work.save(spark.range(0).repartition(3), "none", 0).count() == 0


def test_joins_without_broadcast(spark):
    rows, keys = spark.range(10).toDF("k"), spark.range(5).toDF("k")
    for most in (2, 100):
        assert keep_or_drop(rows, keys, ["k"], "left_anti", most).count() == 5


def test_samples_follow_the_total(spark):
    from tidemill.llm.base import sampled

    rows = spark.range(20_000).toDF("k")
    assert 800 < sampled(rows, "k", 1000, 20_000).count() < 1200
    assert sampled(rows, "k", 1000, 900).count() == 20_000
    assert sampled(rows, "k", 6000, 10**13).count() < 10  # still a threshold above zero


def test_sweep(spark):
    from tidemill.llm import base
    from tidemill.session import Files

    work = Scratch(spark, "gone")
    work.save(spark.range(3).toDF("k"), "t")
    assert Files(spark).exists(work.path("t"))
    base._delete(spark, work.folder)
    assert not Files(spark).exists(work.folder)


def test_lookups_where_only_spark_opens_the_folder(spark, tmp_path, monkeypatch):
    """Decisions about rows take effect also where Arrow doesn't know the store of the shared folder."""
    rng = random.Random(11)
    text = lambda: " ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=40))
    own = [text() for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*own, *(t.upper() for t in own[:9]), *(t + " more" for t in own[9:20]), None, ""])]
    rows += [(None, own[0]), (3, own[3])]
    docs = Scratch(spark, "docs").save(frame(spark, rows), "docs")
    path = public_tokenizers.path("piece_bpe_32k.model")

    def answers(name):
        counts = token_counts.count_tokens(docs, path, str(tmp_path / name))
        made = [exact_dedup.drop_duplicates(docs), ngram_join.keep_one_each(docs), ngram_join.similar_components(docs), counts]
        assert made[0].columns == made[1].columns == docs.columns
        return [sorted(map(repr, x.collect())) for x in made]

    direct = answers("direct")
    assert not base.arrow_opens("nowhere://host/folder") and not base.arrow_opens(str(tmp_path / "absent"))
    monkeypatch.setattr(base, "arrow_opens", lambda folder: False)
    assert answers("joined") == direct
    assert len(direct[0]) == len({low(t) for _, t in rows}) and len(direct[2]) == len(rows)
