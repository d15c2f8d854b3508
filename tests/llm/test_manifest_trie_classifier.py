"""Merkle manifest, prefix trie and quality classifier against plain versions, over whole tables and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import classifier, merkle, queries, trie

from .test_operators import ODD, SF, odd

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- Merkle manifest ---------------------------------------------------------------------------------------------


def plain_tree(leaves):
    """Levels up to one node, three by three."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 3 * 3
        out.append((i - start, [level[j] for j in range(start, min(start + 3, len(level))) if j != i]))
        i //= 3
    return out


def plain_leaf(row, text):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[code(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row.source].append((row.doc_id is not None, row.doc_id or 0, plain_leaf(row, row.text), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = plain_path(trees[s], i) + plain_path(top, k)
            given = row.text.replace("\n", "") if row.text is not None and row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0 else row.text
            at = plain_leaf(row, given)
            for position, others in path:
                at = H(*others[:position], at, *others[position:])
            out.append((row.doc_id, leaf, trees[s][-1][0], top[-1][0], H(*[x for _, run in path for x in run]), at, at == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("count", "height"), [(1, 0), (2, 1), (3, 1), (1, 3), (4, 3), (81, 4), (82, 5), (700, 6)])
def test_traversal(count, height):
    leaves = [H(str(i)) for i in range(count)]
    levels = [leaves]
    for _ in range(height):
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    walk = merkle.Traversal(leaves, height)
    assert walk.root == levels[-1][0]
    for i in range(count):
        assert walk.path() == plain_path(levels, i)
        walk.advance()
    assert walk.widest <= 7 * height


def test_manifest_query(spark, tmp_path):
    odd(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SF, str(tmp_path)):
        got = queries.op11_merkle_manifest(spark, folder).select(*COLUMNS).collect()
        assert sorted(map(tuple, got), key=repr) == plain_manifest(spark.read.parquet(f"{folder}/documents.parquet").collect())


def test_manifest_blocks(spark):
    """Blocks of nine leaves, so paths go over several rounds; one source has half of the rows, and there are many sources."""
    rng = random.Random(3)
    rows = [(i if i % 50 else i // 7, rng.choice(ODD), "en", None if i % 11 == 0 else "hot" if i % 2 else f"s{rng.randrange(40)}", i, "x", 1) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string, n_chars long, _proof string, kept int").repartition(5)
    out = merkle.merkle_manifest(df, keep=["doc_id", "kept", "_proof"], height=2)
    assert out.columns == ["doc_id", "kept", "_leaf", "_subroot", "_root", "_proof"]
    got = out.select("doc_id", "_leaf", "_subroot", "_root", merkle.proof_hash(F.col("_proof")), merkle.folded(F.col("_leaf"), F.col("_proof"))).collect()
    want = plain_manifest(df.collect())
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((w[:5] for w in want), key=repr)
    assert all(r[5] == r["_root"] for r in got)


def test_manifest_single_and_empty(spark):
    one = spark.createDataFrame([(5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.merkle_manifest(one).collect()
    assert row["_leaf"] == row["_subroot"] == row["_root"] == H("1:5----")
    assert row["_proof"] == []
    assert merkle.merkle_manifest(one.limit(0)).collect() == []


# ---- prefix trie -------------------------------------------------------------------------------------------------


def plain_rebuilt(rows):
    sha = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [((r[2] or ""), (r[3] or "")) for r in sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, sha(r)))] for c, rs in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], H(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=repr)


def talk(spark):
    """Families that share turns, equal conversations, one with many turns, null and repeated turns, negative ids."""
    rng = random.Random(5)
    rows = []
    for c in [*range(-12, 60), 1000, 1001, 1004, 2003]:
        for t in range(rng.randrange(0, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b é", "", None])))
    for c in range(300, 345):
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    for c in (500, 700, 701, 705):
        rows += [(c, t, "user", f"long {t % 7}") for t in range(90)]
    rows += [(500, 90, "user", "end"), (None, 1, "user", "nobody"), (800, None, "user", "x"), (800, None, "user", "x"), (800, 3, None, None), (800, 3, "user", "z")]
    return rows + rows[:9]


def test_trie_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 5)
    monkeypatch.setattr(trie, "LISTED", 4)
    rows = talk(spark)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_trie(plain_rebuilt(rows))


def test_trie_operator(spark):
    rows = [(c, t, "u", x) for c, texts in {1: "abc", 2: "abd", 3: "abc", 9: "x"}.items() for t, x in enumerate(texts)]
    df = spark.createDataFrame([(*r, 0, "n") for r in rows], "conv_id long, turn long, role string, text string, place int, sha string")
    turns = trie.ordered_turns(df)
    lengths = trie.lengths(turns).unionByName(spark.createDataFrame([(7, 0)], "conv long, n long"))  # one without turns
    got = sorted((tuple(r)[:-1] for r in trie.prefix_trie(turns, lengths).collect()), key=repr)
    plain = {c: [("u", x) for x in texts] for c, texts in {1: "abc", 2: "abd", 3: "abc", 9: "x", 7: ""}.items()}
    assert got == plain_trie(plain)
    only = trie.prefix_trie(turns.limit(0), lengths.where("n = 0")).collect()
    assert [tuple(r) for r in only] == [(7, 0, None, 1, 0, 1, 0, H("7"), None)]
    assert trie.prefix_trie(turns.limit(0), lengths.limit(0)).collect() == []


# ---- quality classifier ------------------------------------------------------------------------------------------


def split(spark, folder, scores):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id], r.predicted) for r in scores if r.held_out and r.doc_id in labels]
    return [np.array(x) for x in zip(*held, strict=True)]


def test_classifier_held_out(spark):
    """Held-out rows of sf0.1 that no label of the fit is of."""
    got = queries.op12_fourier_features(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    score, label, predicted = split(spark, "/root/testdata/sf0.1", got)
    assert len(label) > 1000
    assert (predicted == label).mean() > 0.97
    good, bad = score[label == 1], score[label == 0]
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.98


def test_classifier_takes_no_other_input(spark, tmp_path):
    """Labels of held-out rows, languages, sources and ids change no score; equal texts score equally; odd texts are scored."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = odd(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 5000)
    docs = docs.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast("int"))).write.parquet(f"{tmp_path}/b/labels.parquet")
    a, b = (sorted(queries.op12_fourier_features(spark, f"{tmp_path}/{x}").collect(), key=repr) for x in "ab")
    assert len(a) == docs.count()
    assert [r.doc_id for r in a] == [r.doc_id for r in b]
    assert max(abs(x.score - y.score) for x, y in zip(a, b, strict=True)) < 1e-6
    by_text = defaultdict(set)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in a:
        if r.doc_id is not None:
            by_text[texts[r.doc_id]].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_classifier_without_labels(spark):
    docs = odd(spark).withColumn("_x", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, label double")
    out = classifier.score_quality(docs, none)
    assert out.columns == [c for c in docs.columns if c not in ("text", "_x")] + ["_score"]
    assert {r["_score"] for r in out.collect()} == {0.5}
    one = spark.createDataFrame([(i, 1.0) for i in range(10)], "doc_id long, label double")
    assert min(r["_score"] for r in classifier.score_quality(docs, one).collect()) > 0.9
    assert classifier.score_quality(docs.limit(0), one).collect() == []


def test_fourier_map_is_a_gaussian_kernel():
    x = np.random.default_rng(1).normal(size=(40, 5))
    mapped = classifier.FourierMap(np.zeros(5), np.ones(5), 20_000, 2.0, 1)
    phi = mapped(x)[:, 1:]
    assert np.abs(phi @ phi.T - np.exp(-((x[:, None] - x) ** 2).sum(2) / 8)).max() < 0.05


def test_isotonic():
    at, means = classifier.isotonic([(0.0, 10, 0.0), (0.2, 1, 1.0), (0.3, 1, 0.0), (0.9, 20, 1.0)])
    assert (np.diff(at) >= 0).all()
    assert (np.diff(means) >= 0).all()
    assert means[0] < 0.1 and means[-1] > 0.95
    assert means[2] == means[3] == 0.5
