"""The manifest against a tree folded by hand, on odd rows and on the given documents."""

import zlib

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from riskscope.llm import merkle, queries


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return brute.sha("".join(parts))


def levels(nodes):
    """Levels from the nodes up to their root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([brute.sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, at):
    """(left, right) siblings from a bottom node to the root."""
    out = []
    for level in tree[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); rows of the query."""
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for members in by.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in groups}
    top = levels([trees[s][-1][0] for s in groups])
    out = []
    for g, s in enumerate(groups):
        for at, row in enumerate(by[s]):
            path = way(trees[s], at) + way(top, g)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            text = row[4].encode().lower().decode() if bad else row[4]
            node = leaf((*row[:4], text))
            for left, right in path:
                node = brute.sha(left + node + right)
            proof = brute.sha("".join(x + y for x, y in path))
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def odd_rows():
    rows = [(i, f"s{i % 19}", "en", i, f"Text {i}") for i in range(60)]
    rows += [(1000 + i, "hot", None, None, f"É{i} Ü") for i in range(300)]
    rows += [(None, "hot", "en", 1, "a"), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(7, "hot", "en", 1, "b"), (7, "hot", "en", 1, "A"), (7, "hot", "en", 1, "A"), (-5, "", "en", 0, ""), (-6, "", "", 0, None)]
    return rows + [(5000, "long", "en", 1, "Word " * 100_000), (5001, "zé", "en", 1, "one")]


SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string"


def found(spark, path):
    df = queries.QUERIES["op11_merkle_manifest"](spark, path)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ["tree", "pos", "n", "node", "at", "c0", "path", "root"]})
    df.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(spark, str(tmp_path))
    assert got == sorted(manifest(rows), key=repr)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.ORACLES['op11_merkle_manifest']})")
    assert got == sorted(sql.fetchall(), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    got = merkle.manifest_proofs(spark.createDataFrame(rows, SCHEMA))
    proofs = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path"))).collect()
    assert sorted(map(tuple, proofs)) == sorted(r[:5] for r in manifest(rows))


def test_given_documents(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()
    assert found(spark, sf_dir) == sorted(manifest([tuple(r) for r in given]), key=repr)
