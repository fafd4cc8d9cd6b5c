"""Exact dedup, Merkle manifest and fill-in-the-middle against brute force:
fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns,
and the driver's smallest tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from learnlens.llm import common, exact, fim, merkle, queries
from tests.conftest import SF0001

LOW = str.maketrans(common.UPPER, common.LOWER)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, gaps, ties."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "Bb", "é", "\x01", "\x01\x02", "<S", "ß ü", "\n\t", "  ", "C\x0b"])
    rows = [(i, "".join(word() + " " * rng.randint(0, 1) for _ in range(rng.randint(0, 40))),
             rng.choice(["en", None]), f"s{rng.randint(0, 2)}", rng.choice([i, None])) for i in range(300)]
    rows += [(400 + i, rows[i % 7][1], "en", "hot", 1) for i in range(150)]
    rows += [(600, None, None, None, None), (601, "", "", "", 0), (602, " ", "en", "é", 1), (603, "<P>x", "en", "s0", 4),
             (604, "abc" * 5000, "en", "s1", 15000), (605, "abc" * 5000, "en", "lone", 15000),
             (606, "abc" * 4999 + "acb", "en", "s1", 15000), (607, "ABC", "en", "s1", 3), (608, "abc", "en", "s1", 3),
             (609, "tail \n ", "en", "s2", 7), (610, "x\x00", "en", "s2", 2), (611, "x", "en", "s2", 1)]
    rng.shuffle(rows)
    return rows


NAMED = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ["row", "at", "fp", "n", "h0", "leaf", "ordinal", "_part", "tree", "form", "bytes", "_sha"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), NAMED).repartition(4)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMED)


def tables(spark):
    return [tuple(r) for r in common.table(spark, SF0001, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]


# ---- exact duplicates


def polynomial(data: bytes, base: int) -> int:
    return sum(b * pow(base, i, exact.PRIME) for i, b in enumerate(data)) % exact.PRIME


@pytest.mark.parametrize("base", [exact.BASE, 1, 3])
def test_fingerprints_compose_from_chunks(base):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    data[:200] = 255
    hasher = exact.Hasher(base, 64)
    starts = np.array([0, 0, 10, 64, 200, 1000, 5000])
    sizes = np.array([0, 200, 64, 1, 65, 4000, 0])
    want = [polynomial(data[s:s + n].tobytes(), base) for s, n in zip(starts, sizes, strict=True)]
    assert hasher.texts(data, starts, sizes).tolist() == want
    # Shares of parts in any order add up to the whole's.
    cuts = [(0, 3), (3, 60), (60, 124), (124, 187)]
    parts = hasher.runs(data, np.array([a for a, _ in cuts]), np.array([b - a for a, b in cuts])).tolist()
    assert sum(hasher.at(p, a) for p, (a, _) in zip(parts, cuts, strict=True)) % exact.PRIME == polynomial(data[:187].tobytes(), base)


def test_largest_sums_stay_exact():
    hasher = exact.Hasher()
    data = np.full(exact.CHUNK, 255, np.uint8)
    got = hasher.runs(data, np.array([0]), np.array([exact.CHUNK])).tolist()
    assert got == [polynomial(data.tobytes(), exact.BASE)]


def brute_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g)


def found(df, **more):
    own = {"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    return sorted(tuple(r) for r in exact.classes(df, carry=own, **more).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("more", [
    {}, {"chunk": 64, "huge": 128}, {"max_broadcast": 0},
    # Weak fingerprints (a sum of bytes; the first byte): every group of equal length
    # that collides must be told apart by its texts.
    {"base": 1, "chunk": 64, "huge": 128}, {"base": 0, "max_broadcast": 0}])
def test_classes_against_brute_force(docs, more):
    assert found(docs, **more) == brute_classes([r[:2] for r in documents()])


def test_exact_query_on_whole_table(spark):
    got = sorted(tuple(r) for r in queries.op11_exact_dedup(spark, SF0001).collect())
    assert got == brute_classes([r[:2] for r in tables(spark)])


def test_exact_edges(spark, empty):
    assert found(empty) == [] and exact.deduplicated(empty).collect() == []
    rows = [(None, "a", 1), (None, "a", 2), (3, "b", 1), (3, "b", 1), (3, "c", 1), (None, None, 1), (4, "", 9), (4, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = [tuple(r) for r in exact.classes(df).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=str) == sorted([
        (None, None, 2, True), (None, None, 2, False), (3, 3, 2, True), (3, 3, 2, False), (3, 3, 1, True),
        (None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, False)], key=str)
    kept = sorted((r.doc_id, r.text or "") for r in exact.deduplicated(df).collect() if r.doc_id is not None)
    assert kept == [(3, "b"), (3, "c"), (4, "")]
    assert exact.deduplicated(df).count() == 4 and exact.deduplicated(df).columns == df.columns


def test_a_group_with_a_third_of_all_rows(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    for most in (0, 1 << 24):
        got = exact.classes(df, max_broadcast=most).where("group_size > 1").agg(
            F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
        assert tuple(got) == (2000, 5997, 5997, 1)


# ---- Merkle manifest


def brute_manifest(rows, fanout=16):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, lower):
        i, text, lang, source, n = r
        return sha("".join(map(field, (i, source, lang, n, text.translate(LOW) if lower and text else text))))

    def up(nodes):
        """(root, the siblings of each node on its way)"""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k:k + fanout] for k in range(0, len(nodes), fanout)]
            for j, a in enumerate(at):
                run = runs[a // fanout]
                ways[j].append((a % fanout, run))
                at[j] = a // fanout
            nodes = [sha("".join(run)) for run in runs]
        return nodes[0], ways

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], []
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, False)))
        top, ways = up([leaf(r, False) for r in members])
        tops.append(top)
        inner.append((members, ways))
    root, top_ways = up(tops)
    out = []
    for (members, ways), top, upper in zip(inner, tops, top_ways, strict=True):
        for r, way in zip(members, ways, strict=True):
            f = leaf(r, zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 5 == 0)
            for pos, run in way + upper:
                f = sha("".join([*run[:pos], f, *run[pos + 1:]]))
            proof = "".join(h for pos, run in way + upper for k, h in enumerate(run) if k != pos)
            out.append((r[0], leaf(r, False), top, root, sha(proof), f, f == root))
    return sorted(out, key=str)


def manifested(df):
    rows = merkle.manifest(df, tampered=common.crc_mod("doc_id", 5) == 0)
    got = rows.select("doc_id", *[merkle.hexed(c) for c in ("leaf", "subroot", "root")],
                      F.sha2(F.array_join(F.transform("proof", merkle.hexed), ""), 256),
                      merkle.hexed("folded_root"), "verified").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_manifest_against_brute_force(docs):
    assert manifested(docs) == brute_manifest(documents())


def test_manifest_with_many_sources_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 7)
    rows = [(r[0], r[1], r[2], f"{r[0] % 40}", r[4]) for r in documents()]
    rows += [(None, "x", None, "1", 1), (None, "y", None, "1", 1), (5, "dup", "en", "2", 3), (5, "dup", "en", "2", 3)]
    assert manifested(spark.createDataFrame(rows, NAMED).repartition(3)) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "s", 1)], [(1, "A", "en", "s", 1), (2, "B", "en", None, 1)],
                                  [(i, "A", "en", "s", 1) for i in range(17)]])
def test_small_manifests(spark, rows):
    assert manifested(spark.createDataFrame(rows, NAMED)) == (brute_manifest(rows) if rows else [])


def test_nodes_are_linked_to_their_parents(docs):
    made = merkle.build(docs, F.col("source"), F.col("doc_id"), F.col("text"))
    nodes = {(r.tree, r.level, r.no): r for r in made.nodes.collect()}
    roots = [r for r in nodes.values() if r.p_tree is None]
    assert len(roots) == 1
    for r in nodes.values():
        assert hashlib.sha256(bytes(r.children).hex().encode()).digest() == bytes(r.hash)
        if r.p_tree is not None:
            parent = nodes[r.p_tree, r.p_level, r.p_no]
            assert bytes(parent.children)[32 * r.pos:32 * r.pos + 32] == bytes(r.hash)


def test_ordinals_are_the_places_in_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 50, "x") for i in range(400)], "k int, t string").repartition(5)
    got = sorted((r.ordinal, r.k) for r in merkle.with_ordinal(df, [F.col("k")], "test").collect())
    assert [o for o, _ in got] == list(range(400)) and [k for _, k in got] == sorted(i * 37 % 50 for i in range(400))


def test_merkle_query_on_whole_table(spark):
    got = sorted((tuple(r) for r in queries.op12_merkle(spark, SF0001).collect()), key=str)
    assert got == brute_manifest(tables(spark))


# ---- fill in the middle


def brute_fim(i, text, seed=42, fim_percent=50, spm_percent=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = sha(f"{seed}:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return i, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_percent:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("share", [(50, 80), (100, 50), (0, 0)])
def test_fim_against_brute_force_and_round_trip(docs, share):
    rows = documents()
    made = fim.restore(fim.transform(docs, fim_percent=share[0], spm_percent=share[1])).collect()
    want = sorted(brute_fim(i, t, 42, *share) for i, t, *_ in rows)
    assert sorted(tuple(r)[:6] for r in made) == want
    assert {r.doc_id: r.restored for r in made} == {i: t or "" for i, t, *_ in rows}


def test_fim_of_odd_texts():
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab \n\t<SPM>é\x00\x01\x02\x03\u0085 \U0001F600") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    odd += ["", " ", "<<S", "x<S", "<P", "word " * 200_000]
    h = [pa.array([rng.getrandbits(32) for _ in odd], pa.int64()) for _ in range(4)]
    p = fim.pieces(pa.array(odd), h, 100, 50)
    assert fim.originals(p["output"], p["form"]).to_pylist() == odd
    assert p["n"].to_pylist() == [len(UNIT.findall(t)) for t in odd]
    assert [a + b + c for a, b, c in zip(*(p[k].to_pylist() for k in ("prefix", "middle", "suffix")), strict=True)] == odd


def test_fim_edges(spark, empty):
    assert fim.restore(fim.transform(empty)).collect() == []
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (2, "")]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), fim_percent=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((brute_fim(i, t, 42, 100) for i, t in rows), key=str)


def test_fim_query_on_whole_table(spark):
    got = sorted(tuple(r) for r in queries.op13_fim(spark, SF0001).collect())
    want = [brute_fim(i, t) for i, t, *_ in tables(spark)]
    text = {i: t or "" for i, t, *_ in tables(spark)}
    assert got == sorted((*w[:5], sha(w[5]), sha(text[w[0]])) for w in want)
