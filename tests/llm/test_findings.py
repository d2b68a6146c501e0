"""Cases that a review found missing."""

import random
import zlib

import numpy as np

from tallyloom.llm import embeddings, fingerprints, minhash, range_coder, token_ids
from tallyloom.llm.common import tokenizer_path
from tallyloom.llm.queries import QUERIES

from test_operators import brute_components


def shingle_likeness(a, b, width=12):
    """Jaccard of two texts' sets of shingles, by brute force."""
    x, y = ({t[i : i + width] for i in range(max(1, len(t) - width + 1))} if t else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_of_short_texts(spark):
    """Texts of few shingles are told apart, exactly; longer ones within five deviations."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcde fghij") for _ in range(n))
    texts = [say(n) for n in (1, 2, 5, 11, 12, 13, 20, 20, 30, 60, 110, 150) for _ in range(3)] + ["", None, say(4)]
    texts += [say(n) for n in (300, 3000, 5000, 40000)]
    texts.append(texts[-1] + say(9000))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprints.compare_with_next(df).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(texts)))
    for r, own, after in zip(rows, texts, texts[1:] + texts[:1]):
        own, after = own or "", after or ""
        for got, want in ((r["near_edited"], shingle_likeness(own, r["edited"])), (r["near_next"], shingle_likeness(own, after))):
            assert got == want if max(len(own), len(after), len(r["edited"])) < 250 else abs(got - want) < 5 * 0.5 / 16
    prints = {}
    for r, text in zip(rows, texts):
        prints.setdefault(r["fingerprint"], set()).add(text or "")
    assert all(len(same) == 1 for same in prints.values())


def test_fingerprints_merge_by_the_same_rule():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(9000))
    for n in (8, 200, 300, 3000, 9000):
        for cut in (n // 7, n // 2, n - 1):
            whole = fingerprints.sketch(text[:n])
            merged = fingerprints.merge(fingerprints.sketch(text[: max(cut, 0) + 11][:n]), fingerprints.sketch(text[cut:n]))
            if n - cut >= 12:
                assert (merged == whole).all()


def test_next_of_large_ids(spark):
    """Ids beyond 2^53 aren't doubles: every row still comes out once, with the next row's text."""
    rng = random.Random(5)
    ids = sorted([rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)] + [(1 << 62) + k for k in range(60)] + [(1 << 63) - 1])
    rows = [(None, "none")] + [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    for ranges in (5, 40):
        dealt = fingerprints.with_next(df, ranges=ranges)
        assert dealt.where("copied = 0").count() == len(rows) and dealt.select("range").distinct().count() > 1
    got = {r["id"]: r["edited"] for r in fingerprints.compare_with_next(df).collect()}
    assert got == {i: t[: len(t) - len(t) // 4] + u[: len(t) // 4] for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1])}


def test_near_duplicates_under_repeated_and_null_ids(spark):
    """Two texts under one id, and texts without id, keep their own links."""
    rng = random.Random(6)
    say = lambda: [f"w{rng.randrange(5000)}" for _ in range(80)]
    text = lambda words: " ".join(words)
    a, b, c, d = say(), say(), say(), say()
    near = lambda words: text([*words[:79], "other"])
    rows = [(7, text(a)), (7, text(b)), (20, near(a)), (30, near(b)), (None, text(c)), (40, near(c)), (None, near(d)), (None, text(d)), (50, text(say()))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["id"] or 0, r["component_id"]) for r in minhash.near_duplicates(df, words=4).collect()))
    nameless = [x for i, x in got if not i and x != 40]
    assert len(nameless) == 2 and nameless[0] == nameless[1] is not None
    assert [x for x in got if x[0] or x[1] == 40] == [(0, 40), (7, 7), (7, 7), (20, 7), (30, 7), (40, 40), (50, 50)]


def test_vectors_under_repeated_and_null_ids(spark):
    """Two vectors under one id, and vectors without id, have their own links and components."""
    a, b, c, d = np.eye(8, dtype=np.float32)[:4].tolist()
    near = lambda v, k: [x or (0.1 if i == k else 0.0) for i, x in enumerate(v)]
    rows = [(7, a), (7, b), (20, near(a, 5)), (21, near(a, 6)), (30, near(b, 5)), (None, c), (40, near(c, 5)), (None, d), (None, d), (50, np.eye(8)[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["id"] or 0, r["n_links"], r["component_id"] or 0) for r in embeddings.link_vectors(df, miss=1e-6).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 1, 40), (7, 1, 7), (7, 2, 7), (20, 2, 7), (21, 2, 7), (30, 1, 7), (40, 1, 40), (50, 0, 50)]


def test_registered_queries(spark, tmp_path):
    """op2, op5 and op8 with their defaults against brute force."""
    rng, vectors = random.Random(7), np.random.default_rng(7)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join([*base[i % 6][: 60 - i % 4], *[f"x{rng.randrange(900)}" for _ in range(i % 4)]]) for i in range(48)]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    middle = vectors.standard_normal((8, 32))
    v = (middle[np.arange(64) % 8] + vectors.standard_normal((64, 32)) * 0.15).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))

    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    roots = brute_components(range(48), [(a, b) for a in range(48) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op8_minhash_near_dedup"](spark, str(tmp_path)).collect()} == {i: (len(sets[i]), roots[i], roots[i] == i) for i in range(48)}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    roots = brute_components(range(64), np.argwhere(close).tolist())
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op2_embedding_near_dedup"](spark, str(tmp_path)).collect()} == {i: (int(close[i].sum()), roots[i]) for i in range(64)}
    for r in QUERIES["op5_fingerprints"](spark, str(tmp_path)).collect():
        own, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 48]
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        assert abs(r["near_next"] - shingle_likeness(own, after)) < 0.16 and abs(r["near_edited"] - shingle_likeness(own, edited)) < 0.16


def test_new_units_need_no_lookahead():
    """Ids of units with and without runs of white space; the former alone take the pattern with a lookahead."""
    table = token_ids.IdTable(tokenizer_path("byte_bpe_50k.json"))
    assert "(?!" not in table.ranked_plain._pat_str and "(?!" in table.ranked._pat_str
    texts = ["on a\nb", "on a\n\nb\n\t\nc's", "it's 12.\tA", "  two  ", "a \n b", "é,\nÜ's\r\n-- 3½", "日本 a\n\n\nb", "", "\n", "<|endoftext|> a\nb"]
    for some in (texts, texts[::-1], [t + " " + u for t in texts for u in texts]):
        assert table.encode(some) == [np.asarray(e.ids, "<u4").tobytes() for e in table.library.encode_batch(some, add_special_tokens=False)]


def test_blocks_stay_as_they_were():
    """The bytes of a block are those of the coder before its loops were rewritten."""
    x, ids = 12345, []
    for k in range(60000):
        x = (x * 1103515245 + 12345) % (1 << 31)
        ids.append((x >> 12) % (40 if k % 3 else 50257))
    block = range_coder.encode_block(np.asarray(ids, np.uint32), 50257)
    assert (len(block), zlib.crc32(block)) == (79352, 3013519406)
    assert range_coder.decode_block(block).tolist() == ids
