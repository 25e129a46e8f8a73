"""Repeated ids and rows, large groups, stored maps, and what is left behind."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from anchorage.llm import common, graph, minhash, mixing, sharding, stages, toxicity
from tests.llm.conftest import prose
from tests.llm.test_documents import components, mix_targets


def files(spark) -> set[str]:
    return {str(p) for p in Path(common.shared_folder(spark).removeprefix("file:")).glob("*")}


# ---------------------------------------------------------------- mixing


def test_mixture_keeps_sources_apart(spark):
    """Rows alike in id and text count for their own source; none comes more than twice as often."""
    r = random.Random(4)
    rows = [(1, "a b c d", "x", "first"), (1, "a b c d", "y", "second"), (1, "a b c d", "y", "third"), (1, "a b c d", None, "fourth")]
    rows += [(k, prose(r, 20), r.choice(["x", "y", None]), "other") for k in range(2, 40)]
    rows += [(50, "same words here", "x", "copy")] * 7 + [(50, "same words here", "x", "other copy")] * 2 + [(None, "no id at all", "y", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(4)
    got = Counter(tuple(x) for x in mixing.mixture(docs).collect())
    had = Counter(rows)
    assert set(got) <= set(had) and all(n <= 2 * had[x] for x, n in got.items())
    taken = Counter()
    for x in mixing.mixed(docs).collect():
        taken[x.doc_id, x.source, x["size"]] += x.taken
    held = Counter()
    for (doc_id, text, source, _), n in got.items():
        held[doc_id, source, len(text.split())] += n * len(text.split())
    assert +taken == +held
    copies = {x[3]: got[x] for x in got if x[0] == 50}
    assert abs(copies.get("copy", 0) - 7 * sum(copies.values()) / 9) < 1
    again = Counter(tuple(x) for x in mixing.mixture(docs.repartition(3)).collect())
    assert again == got


def test_targets_of_many_sources(spark):
    r = random.Random(9)
    sizes = {f"s{k:04}": int(10 ** r.uniform(0, 6)) for k in range(700)} | {"empty": 0}
    frame = spark.createDataFrame([("k" + s, n) for s, n in sizes.items()], "key string, source_size long").repartition(6)
    got = {x.key[1:]: x.target for x in mixing.targets(frame, mixing.Mix()).collect()}
    expected = mix_targets(sizes)
    assert got.keys() == expected.keys()
    assert all(abs(got[s] - expected[s]) <= 1e-6 * max(1.0, expected[s]) for s in expected)


def test_targets_not_met_are_an_error(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(k, prose(r, r.randrange(1, 90)), "a" if k % 9 else "b") for k in range(80)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="did not meet the targets"):
        mixing.mixed(docs, mixing.Mix(steps=0)).collect()


# ---------------------------------------------------------------- near duplicates


def near_copies(r: random.Random, n: int) -> list[tuple]:
    """Two families of near copies that share most of their text, chains within them, and other documents."""
    base = prose(r, 150).split()
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(k % 4):
            words[r.randrange(150)] = f"x{r.randrange(50)}"
        if k % 3 == 0:
            words[100:135] = [f"y{j}" for j in range(35)]  # far from the smallest, near to each other
        rows.append((1000 + 7 * k, " ".join(words)))
    rows += [(k, prose(r, 120)) for k in range(20)]
    return rows


@pytest.mark.parametrize("block", [4, 16])
def test_large_groups_lose_no_link(spark, block):
    rows = near_copies(random.Random(5), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = components(rows)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, minhash.Params(block_documents=block)).collect()}
    assert got == expected and len(set(expected.values())) > 21


def test_kept_rows_are_chosen_by_their_columns(spark):
    text = prose(random.Random(6), 80)
    rows = [(3, text, "b", 2), (3, text, "a", 9), (3, text, "a", 4), (5, text, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_key string, kept int")
    for parts in (1, 4):
        assert [tuple(x) for x in minhash.kept_documents(docs.repartition(parts)).collect()] == [(3, text, "a", 4)]


def test_components_of_stars_and_chains(spark):
    r = random.Random(3)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000 + r.randrange(60), 2000 + r.randrange(60)) for _ in range(50)]
    r.shuffle(edges)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in parent if x in got} and all(a in got for a, b in edges if a != b)


# ---------------------------------------------------------------- sharding


def test_map_is_stored_edited_and_read_back(spark, tmp_path):
    path = f"file:{tmp_path}/map"
    r = random.Random(2)
    records = spark.createDataFrame([(k, 1 + int(10 ** r.uniform(0, 4))) for k in range(3000)], "doc_id long, size long")
    first, one = sharding.shard_records(records, 4, 256, path)
    loads = Counter()
    for x in first.collect():
        loads[x.shard] += x["size"]
    mean = sum(loads.values()) / 4
    assert max(loads.values()) - min(loads.values()) <= 0.01 * mean
    assert sharding.SlotMap.load(spark, path) == one and len(one.versions) == 2
    # In balance, nothing moves and no version is added.
    _, same = sharding.shard_records(records, 4, 256, path)
    assert same == one
    # More records: slots move, history stays.
    more = records.unionByName(spark.createDataFrame([(k, 50_000) for k in range(5000, 5003)], "doc_id long, size long"))
    second, two = sharding.shard_records(more, 4, 256, path)
    assert two.versions[:2] == one.versions and len(two.versions) == 3 and sharding.SlotMap.load(spark, path) == two
    assert sum(a != b for a, b in zip(one.current, two.current, strict=True)) < 128
    by_slot = {x.virtual_slot: x.shard for x in second.collect()}
    assert all(two.current[slot] == shard for slot, shard in by_slot.items())
    with pytest.raises(ValueError, match="256 slots"):
        sharding.shard_records(records, 4, 64, path)


def test_bytes_law_on_the_query(spark, docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    loads = Counter()
    for x in got:
        loads[x.shard] += x["size"]
    # No shard can be better than the largest text allows.
    largest = max(len((x[1] or "").encode()) + 1 for x in rows)
    others = [n for s, n in loads.items()]
    assert len(others) == 4 and max(others) <= max(largest, sum(others) / 4) + 5000


# ---------------------------------------------------------------- toxicity


def test_bound_holds_for_repeated_ids(spark):
    r = random.Random(8)
    rows = [(k % 40, " ".join(["meanie"] * (k % 40 < 20) + [f"w{r.randrange(30)}" for _ in range(20)])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)] * 3 + [(None, 1)], "doc_id long, toxic int")
    params = toxicity.Params(max_rows=30, precision=0.8)
    seen = []
    plain = toxicity.train
    toxicity.train = lambda index, row, marks, p: seen.append(len(marks)) or plain(index, row, marks, p)
    try:
        one = toxicity.train_on(docs, labels, {"toxic": F.col("toxic") == 1}, params)
        two = toxicity.train_on(docs.repartition(2), labels, {"toxic": F.col("toxic") == 1}, params)
    finally:
        toxicity.train = plain
    assert seen == [30, 30] and (one[0].weights == two[0].weights).all()
    got = toxicity.predict(docs, one, ["toxic"], params).collect()
    assert sum(x.toxic == (x.doc_id < 20) for x in got) > 0.9 * len(got)


# ---------------------------------------------------------------- what is left behind


def test_a_run_leaves_only_the_last_input(spark, docs):
    before = files(spark)
    stages.run(spark, docs, "").count()
    left = files(spark) - before
    assert len(left) == 1 and next(iter(left)).endswith("mix_sources")


def test_stashes_go(spark):
    before = files(spark)
    one = common.stash(spark.range(10))
    assert one.count() == 10 and len(files(spark) - before) == 1
    common.discard(one)
    with common.scratch():
        common.stash(spark.range(5))
        assert len(files(spark) - before) == 1
    assert files(spark) == before


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Unset:
        def isEmpty(self):
            return True

    class Context:
        def __init__(self, master):
            self.master = master
            self._jsc = self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Unset()

        def setCheckpointDir(self, folder):
            raise AssertionError(folder)

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(Session(master))
    for master in ("local", "local[4]", "local[*]"):
        with pytest.raises(AssertionError, match="checkpoints-"):
            common.shared_folder(Session(master))
