"""Pairs of many rows: spread over tasks, and as exact as by the plain way."""

from pyspark.sql import functions as F

from trajectra.operators import distances as D
from trajectra.operators import sequences as Q


def _frame(spark, sequences, states="abc"):
    rows = [(i, p, s) for i, seq in enumerate(sequences) for p, s in enumerate(seq, 1)]
    return Q.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", list(states))


def test_many_copies_of_few_sequences_are_expanded_by_many_tasks(spark):
    f = _frame(spark, ["ab" if i % 2 else "aa" for i in range(2500)])
    found = D.expand(f, D.pairwise(f, "HAM")).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.countDistinct("i", "j").alias("m")).collect()
    total = sum(r.n for r in found)
    assert total == sum(r.m for r in found) == 2500 * 2499 // 2
    assert sum(r.d for r in found) == 1250 * 1250
    assert max(r.n for r in found) < 0.75 * total


def test_directed_pairs_of_several_blocks_are_compared_once_from_the_lesser_id(spark, monkeypatch):
    import numpy as np

    from trajectra.functions import kernels as K

    rng = np.random.default_rng(5)
    sequences = sorted({"".join("abc"[v] for v in rng.integers(0, 3, rng.integers(3, 9))) for _ in range(230)}, key=lambda s: s[::-1])
    f = _frame(spark, sequences)
    costs = K.padded_costs((2 * (1 - np.eye(3))).tolist())
    blocks = K.Block.of([["abc".index(c) + 1 for c in s] for s in sequences])
    d = K.localized(blocks, blocks, costs, 0.1, 0.8)[0]
    ids = {tuple(r.seq): r.id for r in f.arrays.collect()}
    at = {ids[tuple("abc".index(c) + 1 for c in s)]: k for k, s in enumerate(sequences)}
    found = D.pairwise(f, "OMloc", expansion=0.1).collect()
    assert len(found) == len({(r.i, r.j) for r in found}) == len(sequences) * (len(sequences) - 1) // 2
    assert all(r.i < r.j and abs(r.d - d[at[r.i], at[r.j]]) < 1e-9 for r in found)
    # The kernel is called for one direction alone.
    unique = D.unique_sequences(f).select("uid", "seq")

    def spans(a, b, same):
        u, v = a.column("uid").to_numpy(), b.column("uid").to_numpy()
        return D._table(np.array([len(u) * len(v)]), np.array([0]), np.array([float(same or not len(u) or not len(v) or u.max() < v.min())]))

    assert {r.d for r in D.block_pairs(unique, spans, "i long, j long, d double", ordered=True).collect()} == {1.0}


def test_whole_costs_are_summed_in_short_integers():
    import numpy as np

    from trajectra.functions import kernels as K

    assert K._whole([np.array([0.0, 1.5, 1.0])], 200.0) == (np.int16, 2.0)
    assert K._whole([np.array([0.2, 1.8, 2.0])], 400.0) == (np.int16, 5.0)
    assert K._whole([np.array([0.125])], 1e6) == (np.int32, 8.0)
    assert K._whole([np.array([1 / 3])], 10.0) == (np.float64, 1.0)


def _kept(monkeypatch):
    """Row counts of the tables that clustering stores."""
    from trajectra.operators import clustering as C
    from trajectra.operators import tables

    kept, plain = [], tables.stored

    def stored(df):
        out = plain(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(tables, "stored", stored)
    monkeypatch.setattr(C, "stored", stored)
    return kept


def test_silhouettes_and_fuzzy_indices_store_no_pair_table(spark, monkeypatch):
    from trajectra.operators import clustering as C

    f = _frame(spark, ["".join("abc"[(k // 3**p) % 3] for p in range(4)) for k in range(60)])
    pairs = D.pairwise(f, "HAM")
    rows = D.unique_sequences(f).select(F.col("uid").alias("id"), "weight", (F.col("uid") % 2).cast("int").alias("cluster"))
    kept = _kept(monkeypatch)
    assert C.silhouettes(pairs, rows).count() == 60
    assert not kept
    medoids = spark.createDataFrame([(0, 0), (1, 59)], "cluster int, medoid long")
    memberships = rows.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cluster"), F.lit(0.5).alias("u"))
    found = C.fuzzy_indices(pairs, memberships, medoids, rows).first()
    assert found.db > 0 and found.xb > 0
    assert kept and max(kept) <= 2 * 60


def test_mismatches_are_counted_in_short_integers():
    import numpy as np

    from trajectra.operators import uncertainty as U

    rng = np.random.default_rng(2)
    for most in (6, 1000):
        x, y = rng.integers(0, most, (7, 31)), rng.integers(0, most, (5, 31))
        found = U._mismatches(x, y)
        assert found.dtype == np.int16
        assert (found == (x[:, None] != y[None]).sum(axis=2)).all()


def test_blocks_travel_packed_and_their_pairs_leave_part_by_part(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    sequences = sorted({"".join("abc"[v] for v in rng.integers(0, 3, 12)) for _ in range(600)})
    f = _frame(spark, sequences)
    unique = D.unique_sequences(f).select("uid", "seq")
    # Sequences that a block pair holds, and the largest table that leaves it: blocks of 8 parts of 16 rows.
    sizes = D.block_pairs(unique, lambda a, b, same: D._table(np.array([a.num_rows]), np.array([b.num_rows]), np.array([1.0])), "i long, j long, d double", block=16).collect()
    assert max(max(r.i, r.j) for r in sizes) <= 16
    pairs = D.pairwise(f, "HAM", block=16)
    assert pairs.count() == pairs.select("i", "j").distinct().count() == len(sequences) * (len(sequences) - 1) // 2
    # A block is one row to each block it meets, not a row per sequence.
    met = D.packed_pairs(unique, lambda a, b, same: [D._table(np.array([a.num_rows]), np.array([b.num_rows]), np.array([0.0]))], "i long, j long, d double", block=128)
    assert met.count() <= (-(-len(sequences) // 96) + 1) ** 2 / 2 + 8


def test_pairs_against_a_reference_join_nothing_to_the_pairs(spark):
    f = _frame(spark, ["aab", "abb", "aaa", "ccc", "cab"])
    refs = D.to_references(f, [[1, 1, 1]], "HAM").select("i", "d").withColumnRenamed("d", "r")
    one, other = D.elzinga_studer_pairs(f, [1, 1, 1], "HAM"), D.elzinga_studer(D.pairwise(f, "HAM"), refs)
    assert {(r.i, r.j): r.d for r in one.collect()} == {(r.i, r.j): r.d for r in other.collect()}
    assert "Join" not in one._jdf.queryExecution().executedPlan().toString()


def test_mismatches_in_bits_equal_a_loop():
    import numpy as np

    from trajectra.functions import kernels as K

    rng = np.random.default_rng(3)
    for width, k in ((1, 2), (31, 6), (33, 9), (70, 5), (300, 3)):
        x, y = rng.integers(1, k + 1, (7, width)), rng.integers(1, k + 1, (9, width))
        found = K.mismatches(K.bit_planes(x, k), K.bit_planes(y, k))
        assert (found == (x[:, None] != y[None]).sum(axis=2)).all()
        costs = K.padded_costs((1.5 * (1 - np.eye(k))).tolist())
        assert (K.hamming(K.Block.of(x.tolist()), K.Block.of(y.tolist()), costs)[0] == 1.5 * found).all()


def test_common_prefixes_stop_where_no_pair_goes_on():
    import numpy as np

    from trajectra.functions import kernels as K

    rng = np.random.default_rng(4)
    x, y = ([rng.integers(1, 3, rng.integers(0, 9)).tolist() for _ in range(n)] for n in (12, 15))
    common = lambda p, q: next((t for t, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
    for backward in (False, True):
        turned = lambda s: s[::-1] if backward else s  # noqa: B023, E731
        d = K.common_prefix(K.Block.of(x), K.Block.of(y), backward)[0]
        assert all(d[i, j] == len(p) + len(q) - 2 * common(turned(p), turned(q)) for i, p in enumerate(x) for j, q in enumerate(y))


def _changes(pairs):
    """Rows of a pair table, and in which share of them i and d differ from the row before."""
    at = pairs.withColumn("part", F.spark_partition_id()).toPandas()
    same = at.part.eq(at.part.shift())
    return len(at), (at.i.ne(at.i.shift()) & same).mean(), (at.d.ne(at.d.shift()) & same).mean()


def _many(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    return _frame(spark, sorted({"".join("abc"[v] for v in rng.integers(0, 3, 9 + rng.integers(0, 2))) for _ in range(700)}, key=lambda s: s[::-1]))


def _loops(rows, distance):
    return {(a.uid, b.uid): distance(list(a.seq), list(b.seq)) for a in rows for b in rows if a.uid < b.uid}


def test_codes_travel_in_bytes_and_arrive_as_they_were(spark):
    import pyarrow as pa

    for top, sent in ((127, D.NARROW), (128, D.WIDE)):
        rows = pa.table({"uid": pa.array([1, 2], pa.int64()), "seq": pa.array([[1, top], []], pa.list_(pa.int32()))})
        narrow = D._cast(rows, D.WIDE, D.NARROW)
        assert narrow.schema.field("seq").type.value_type == sent
        assert D._cast(narrow, D.NARROW, D.WIDE).equals(rows)


def test_spell_prefix_distances_repeat_from_row_to_row(spark):
    from trajectra.functions import kernels as K

    f = _many(spark)
    pairs = D.pairwise(f, "LCPspell")
    n, i, d = _changes(pairs)
    assert i < 0.1 and d < 0.6  # about 0.48 and 0.89 where blocks are dealt by hash

    def distance(x, y):
        (p, u), (q, v) = K.spells_of(x), K.spells_of(y)
        c = next((t for t, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
        return len(p) + len(q) - 2 * c + sum(abs(u[t] - v[t]) for t in range(c)) / 2

    assert {(r.i, r.j): r.d for r in pairs.collect()} == _loops(D.unique_sequences(f).collect(), distance)
    assert n == pairs.select("i", "j").distinct().count()


def test_shared_spell_time_from_the_end_repeats_from_row_to_row(spark):
    from trajectra.functions import kernels as K

    f = _many(spark)
    pairs = D.pairwise(f, "RLCPmst")
    _, i, d = _changes(pairs)
    assert i < 0.1 and d < 0.3  # about 0.48 and 0.61 where blocks are dealt by hash

    def distance(x, y):
        (p, u), (q, v) = K.spells_of(x[::-1]), K.spells_of(y[::-1])
        c = next((t for t, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
        return len(x) + len(y) - 2.0 * sum(min(u[t], v[t]) for t in range(c))

    assert {(r.i, r.j): r.d for r in pairs.collect()} == _loops(D.unique_sequences(f).collect(), distance)


def test_prefix_distances_repeat_from_row_to_row(spark):
    f = _many(spark)
    pairs = D.pairwise(f, "LCP")
    _, i, d = _changes(pairs)
    assert i < 0.1 and d < 0.4  # about 0.48 and 0.77 where blocks are dealt by hash
    common = lambda x, y: next((t for t, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert {(r.i, r.j): r.d for r in pairs.collect()} == _loops(D.unique_sequences(f).collect(), lambda x, y: len(x) + len(y) - 2.0 * common(x, y))


def _equal_ones(spark):
    return _frame(spark, sorted("".join("abc"[(k * 7919 // 3**p) % 3] for p in range(7)) for k in range(700)))


def test_summed_distances_keep_an_id_in_a_run_of_pairs(spark):
    from trajectra.operators import multidomain as M

    f = _equal_ones(spark)
    pairs = M.summed_distances([f, f], [{"method": "HAM"}, {"method": "HAM"}], [1.0, 2.0])
    assert _changes(pairs)[1] < 0.1  # about 0.48 where blocks are dealt by hash
    assert {(r.i, r.j): r.d for r in pairs.collect()} == _loops(D.unique_sequences(f).collect(), lambda x, y: 3.0 * sum(a != b for a, b in zip(x, y)))


def test_profile_distances_keep_an_id_in_a_run_of_pairs(spark):
    f = _equal_ones(spark)
    pairs = D.pairwise(f, "EUCLID", norm="auto")
    assert _changes(pairs)[1] < 0.1  # about 0.48 where blocks are dealt by hash
    found, wanted = {(r.i, r.j): r.d for r in pairs.collect()}, _loops(D.unique_sequences(f).collect(), lambda x, y: (sum(a != b for a, b in zip(x, y)) / 7) ** 0.5)
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)
