"""The tokenizers' alignment, the repair of conversations and near copies among vectors, each against a brute-force version."""

import random

import numpy as np
import pytest
from spectraframe.llm import alignment, embedding_dedup, repair
from spectraframe.llm.queries import op11_alignment, op12_conversation_repair, op13_embedding_dedup

from . import brute


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = {c: i for i, c in enumerate(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    known = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in known]
    names = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}

    def bytes_a(i):
        return bytes(known[level[c]] if c in level else rest[ord(c) - 256] for c in names.get(i, ""))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: a.encode(t, add_special_tokens=False).ids, bytes_a, b.encode, bytes_b


ODD_TEXTS = ["<|endoftext|> <s></s><unk><0x41>", "▁ x", "  two  spaces \n\n", "日本 \U0001f600́", "\x00a", " ", "ﬁ Ω", "aa" * 5000]


def test_alignment_of_odd_rows(spark, odd, odd_rows, tokenizers):
    extra = spark.createDataFrame([(500 + k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    rows = [*odd_rows, *((500 + k, t) for k, t in enumerate(ODD_TEXTS))]
    got = alignment.alignment_counts(odd.unionByName(extra, allowMissingColumns=True)).collect()
    want = brute.alignment([t for _, t in rows], *tokenizers)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def test_alignment_spells_its_groups(spark, tokenizers):
    docs = spark.createDataFrame([(1, "Étion dans, naïve words")], "doc_id long, text string")
    row = alignment.aligned(docs, spell=True).first()
    ids = [[int(i) for g in row["groups"].split(";") for i in g.split("|")[k].split(",")] for k in range(2)]
    assert ids == [tokenizers[0](" Étion dans, naïve words"), tokenizers[2]("Étion dans, naïve words")]
    assert brute.sha(row["groups"]) == row["groups_sha256"]


def test_alignment_of_an_empty_table(spark, empty):
    assert alignment.alignment_counts(empty).count() == 0


def test_alignment_of_a_batch_that_is_cut(monkeypatch):
    texts = ["one two", "", "three", None, "four five six", "seven"]
    monkeypatch.setattr(alignment, "MOST_BYTES", 8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    parts = list(alignment._parts(batch))
    assert len(parts) > 1
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts


def test_alignment_on_the_table(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute.alignment([r.text for r in docs], *tokenizers)
    got = {r.doc_id: tuple(r)[1:] for r in op11_alignment(spark, sf_dir).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)}


ROLES = ["system", "user", "assistant", "tool", "", None, "u"]


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "", " \t", "cut off", "Why? ", None, "x.\n", "?", "a "]
    rows = []
    for conv in range(n):
        for k in range(rng.randrange(1, most)):
            role = rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES)
            rows.append((conv if conv else None, None if rng.random() < 0.1 else rng.choice([k, k, k + 3, k // 2]), role, rng.choice(texts)))
    return rows


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append((rest[0], " " if rest[1] is None else rest[1], " " if rest[2] is None else rest[2]))
    return out


def test_repair_is_the_least_of_all_ways():
    rows = by_conversation(brute.damage(conversations(3, 60, 5)))
    for own in rows.values():
        assert brute.repair(own, every_way=True) == brute.repair(own)


def test_repair_of_damaged_conversations(spark):
    rows = conversations(5, 300, 14)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_conversations(table, repair.damaged(table)).collect()}
    damaged = by_conversation(brute.damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", brute.sha(""))
    assert got == {c: brute.repair(damaged[c]) if c in damaged else none for c in {r[0] for r in rows}}


def test_repair_of_a_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(7, k // 3, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "cut", "", f"row {k}.", f"row {k}"])) for k in range(6000)]
    rows += [(c, k, "user", "Hm.") for c in (1, 2, 8, 9) for k in range(3)] + [(8, 5, "assistant", "Again.")] * 5000
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
        got = {r.conv: tuple(r)[1:] for r in repair.repair(table).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {c: brute.repair(own) for c, own in by_conversation(rows).items()}


def test_chunks_join_to_the_whole():
    rows = by_conversation(conversations(9, 40, 30))
    for own in rows.values():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), brute.sha(r[2])))
        faults = brute._faults(own)
        for step in (1, 2, 5):
            parts = [repair._part(own[s : s + step], faults[s : s + step], 0, s) for s in range(0, len(own), step)]
            states = repair._joined(parts)[::-1]
            audit, lines = "", []
            for p, s in zip(parts, states, strict=True):
                codes = repair.Paths([(r[:1], f) for r, f in zip(p["roles"], p["faults"], strict=True)], s["start"]).codes(s["end"])
                audit += "".join(codes) + s["closing"]
                lines += repair.repaired(list(zip(p["roles"], p["texts"], strict=True)), codes, s["start"], s["closing"])
            want = brute.repair(own)
            assert (states[0]["gaps"], *(states[0][k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), audit, brute.sha("\n".join(lines))) == want


def test_repair_of_empty_and_clashing_tables(spark):
    kind = "conv_id long, turn long, role string, text string, conv string, copies int, way string, part int, seen boolean"
    none = spark.createDataFrame([], kind)
    assert repair.repaired_conversations(none, repair.damaged(none)).count() == 0
    table = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 9, "y", 3, True), (1, 1, "assistant", "Yes.", "x", 9, "y", 3, True)], kind)
    assert repair.repair(table).first()["audit"] == "KK"


def vectors(seed, n, groups):
    rng = np.random.default_rng(seed)
    rows = [v.tolist() for v in rng.normal(size=(n, 32))]
    for size, spread in groups:
        centre = rng.normal(size=32)
        rows += [(centre + spread * rng.normal(size=32)).tolist() for _ in range(size)]
    return rows


def test_near_vectors_against_all_pairs(spark):
    rng = random.Random(3)
    rows = vectors(3, 600, [(2, 0.1), (40, 0.2), (60, 0.33), (200, 0.05)])
    rows += [rows[0]] * 30 + [[2 * c for c in rows[1]]] + [[1e300 * c for c in rows[2]], [1e-300 * c for c in rows[2]]]
    rows += [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, rows[3][:16], [1.0], [2.0], [-1.0]]
    rng.shuffle(rows)
    table = [(None if k % 97 == 0 else k - k % 41 // 40, v, "x", 1) for k, v in enumerate(rows)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, node string, shard int").repartition(4)).collect()
    want = brute.near_vectors([t[:2] for t in table])
    assert sorted(repr((r["id"], r.n_links, r.component)) for r in got) == sorted(repr((table[k][0], *w)) for k, w in want.items())
    assert all(r.kept == (r["id"] == r.component) for r in got)


def test_near_vectors_of_small_shards(spark):
    rows = vectors(4, 900, [(30, 0.1), (300, 0.3)])
    got = embedding_dedup.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"), most=300).collect()
    want = brute.near_vectors(list(enumerate(rows)))
    assert {r["id"]: (r.n_links, r.component) for r in got} == want


def test_near_vectors_of_an_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_finds_nearly_all_with_a_narrow_beam():
    x = np.array(vectors(6, 4000, [(50, 0.2)] * 20), np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = embedding_dedup.build(x, 1)
    order = graph.layers[0][0]
    assert sorted(order.tolist()) == list(range(len(x)))
    truth = x[::7] @ x[order].T >= 0.9
    hit = embedding_dedup.search(graph, x[::7], 0.9, 16)
    assert not (hit & ~truth).any()
    assert hit.sum() >= 0.97 * truth.sum()


def test_queries_against_sql(spark, duck, sf_dir):
    from spectraframe.llm.sql import oracle_sql

    from ..conftest import rows_of

    for query in (op12_conversation_repair, op13_embedding_dedup):
        assert rows_of(query(spark, sf_dir).toPandas()) == rows_of(duck.execute(oracle_sql()[query.__name__]).df())


def test_pairs_of_shards_need_bounded_memory():
    """Products with a whole shard, all pairs' places and a bit for each pair of two shards were in memory at once, whatever was found."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 6000, 8))
    x[:, :300] = x[0, 0] + 0.02 * rng.normal(size=(2, 300, 8))  # a group of near copies in both
    x /= np.linalg.norm(x, axis=2)[:, :, None]
    sides = [(np.arange(6000) + 6000 * k, np.ones(6000, np.int64), v, embedding_dedup.Graph(v.astype(np.float32), [(np.arange(6000), np.full((6000, 1), -1, np.int32))])) for k, v in enumerate(x)]
    none = np.zeros((512, 6000), bool)
    flat = np.concatenate(x)
    truth = flat @ flat.T >= 0.999
    np.fill_diagonal(truth, False)

    def exact(graph, q, least, width):  # what a beam does is not meant here
        return embedding_dedup._close(q, graph.x, least)

    search, embedding_dedup.search = embedding_dedup.search, exact
    try:
        tracemalloc.start()
        found = embedding_dedup._pair(*sides, 0.999, 0.99)
        most = tracemalloc.get_traced_memory()[1]
        own = [embedding_dedup._pair(side, None, 0.999, 0.99) for side in sides]
    finally:
        tracemalloc.stop()
        embedding_dedup.search = search
    assert most < 6 * none.nbytes  # 12.1 times before, 3.5 now
    links = dict(zip(found["node"], found["links"], strict=True))
    assert [links.get(k, 0) for k in range(12000)] == [*truth[:6000, 6000:].sum(1), *truth[6000:, :6000].sum(1)]
    for k, f in enumerate(own):
        part = slice(6000 * k, 6000 * k + 6000)
        assert dict(zip(f["node"], f["links"], strict=True)) == {i + 6000 * k: n for i, n in enumerate(truth[part, part].sum(1)) if n}


def test_tiles_of_pairs_keep_all_bits():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.001, 0.2, 1.0):
        hit, out = rng.random((50, 37)) < share, np.zeros((37, 50), bool)
        kept = embedding_dedup._kept(hit)
        embedding_dedup._add(out.T, kept)
        assert (out.T == hit).all() and kept.nbytes <= (hit.size + 7) // 8


def test_wide_beams_take_fewer_queries_at_a_time(monkeypatch):
    x = np.array(vectors(6, 1500, [(50, 0.2)] * 5), np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = embedding_dedup.build(x, 1)
    want, widths, beam = embedding_dedup.search(graph, x[::3], 0.9, 64), [], embedding_dedup._beam
    monkeypatch.setattr(embedding_dedup, "WIDE", 64 * 100)
    monkeypatch.setattr(embedding_dedup, "_beam", lambda x, links, q, *rest: (widths.append(len(q)), beam(x, links, q, *rest))[1])
    assert (embedding_dedup.search(graph, x[::3], 0.9, 64) == want).all() and max(widths) == 100


def test_graphs_travel_in_pieces(monkeypatch):
    """A shard's graph was one row of up to 20 MB, which each pair of shards had a copy of."""
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(embedding_dedup, "PIECE", 100)
    x = np.array(vectors(6, 450, []))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [embedding_dedup._graphs(pd.DataFrame({"shard": k, "first": 0, "shards": 2, "node": np.arange(450) + 450 * k, "copies": 1 + np.arange(450) % 3, "v": list(3 * x)})) for k in (0, 1)]
    assert [len(r) for r in rows] == [5, 5] and max(map(len, rows[0]["vectors"])) == 100 * 32 * 8
    sent = pd.concat([t.assign(pair=[{"a": a, "b": b}] * len(t)) for a, b in ((0, 0), (0, 1), (1, 1)) for t in rows[a : b + 1]])
    table = pa.RecordBatch.from_pandas(sent, preserve_index=False)
    sides = list(embedding_dedup._sides(iter([table.slice(k, 3) for k in range(0, table.num_rows, 3)])))
    assert [[s[0].min() // 450 for s in pair] for pair in sides] == [[0], [0, 1], [1]]
    graph = embedding_dedup.build(x.astype(np.float32), 0)
    of = graph.layers[0][0]
    nodes, copies, vectors_, read = sides[1][0]
    assert (nodes == of).all() and (copies == 1 + of % 3).all() and np.allclose(vectors_, x[of], rtol=0, atol=1e-15) and np.allclose(read.x, graph.x)
    for (n, t), (m, u) in zip(read.layers, graph.layers, strict=True):
        assert len(n) == len(m) and (t == u).all()
