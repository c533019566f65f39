"""SimHash fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash

from tonemill.llm import simhash
from tonemill.llm.components import connected_components


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    group = {}
    for i in range(len(ids)):
        group.setdefault(find(i), []).append(ids[i])
    return [min(group[find(i)]) for i in range(len(ids))]


def test_edges_and_query(spark):
    from tonemill.llm.queries import LLM_QUERIES
    from tonemill.llm.ragged import table

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    prints = [brute_print(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints)))
    assert sorted(map(tuple, LLM_QUERIES["op5_simhash"](spark, sf).collect())) == want


def test_defined_cases(spark):
    rows = [(5, None, 1), (3, "", 1), (4, " \n\t ", 1), (9, "One", 1), (9, "One", 1), (8, "one  TWO", 1), (7, "a É b ÉÉ c" + " d" * 5000, 1), (6, "\x0bx\x0cy\x1cz w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SIMHASH int")
    got = {(r.doc_id, r.simhash % 2**64): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {(i, brute_print(t)): (3 if not (t or "").strip() else i) for i, t, _ in rows}
    assert simhash.near_duplicates(df).count() == len(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits,segments", [(3, 2), (3, 4), (2, 3), (0, 1)])
def test_links_are_complete(spark, bits, segments):
    rng = random.Random(bits * 10 + segments)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(4):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    values = sorted({signed(v) for v in values} | {0, 7, -1})
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= bits}
    df = spark.createDataFrame([(v,) for v in values], "simhash long")
    assert set(map(tuple, simhash.links(df, bits, segments).collect())) == want


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(300, 301), (301, 300), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {k: 100 for k in range(101, 161)} | {k: 5 for k in range(200, 260)} | {301: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
