import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, components, counts, embeddings, fingerprints, id_files, language, minhash, packing, pieces, range_coder, repeats, shingles, token_ids
from tallyloom.llm.common import tokenizer_path

RNG = random.Random(9)
WORDS = ["the", "of", "über", "élan", "Straße,", "don't", "x1", "end.", "日本", "\U0001f600", "a" * 40, "--", "we'll"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "\n b", "a\n \nb", "a \n", "it's 'tis ''s", "<|endoftext|> x<|endoftext|>", "\x00\x1c", " x  y", "ﬁ Σ İ", "a" * 700, "ab " * 400, "!" * 300, "\t\t x"]
TEXTS = ODD + [prose(n) for n in (1, 3, 4, 5, 30, 200)]
TEXTS.append(TEXTS[-1])  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    """Ids out of order, a null text, an extra column with a clashing name."""
    rows = [(100 - i, t, "ids") for i, t in enumerate(TEXTS)] + [(500, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def texts_by_id():
    return {100 - i: t for i, t in enumerate(TEXTS)} | {500: ""}


def empty(df):
    return df.limit(0)


def test_token_counts(docs):
    library = counts.CountTransducer(tokenizer_path("byte_bpe_50k.json")).library
    got = {r["id"]: (r["n_bytes"], r["n_tokens"]) for r in counts.count_tokens(docs).collect()}
    assert got == {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_by_id().items()}
    assert counts.count_tokens(empty(docs)).count() == 0


@pytest.mark.parametrize("states", [64, 0])
def test_counts_of_long_runs(monkeypatch, states):
    """Runs without a boundary over many chunks: periodic, random, and between others; by composed maps and chunk by chunk."""
    monkeypatch.setattr(counts, "MAP_STATES", states)
    machine = counts.CountTransducer(tokenizer_path("byte_bpe_50k.json"))
    letters = lambda n, of: "".join(RNG.choice(of) for _ in range(n))
    texts = ["a" * 40_000, "ab" * 9_000, "=" * 7_000, letters(30_000, "abcdefghijklmnopqrstuvwxyz"), letters(9_000, "\u65e5\u672c\u8a9e"), "x " + letters(5_000, "es") + " y " + "1" * 3_000 + "\n", " " * 5_000, letters(4_000, "ab ")]
    _, got = counts.count_batch(machine, pa.array(texts))
    assert got.tolist() == [len(e.ids) for e in machine.library.encode_batch(texts, add_special_tokens=False)]


def test_counts_cross_chunks_and_flushes():
    machine = counts.CountTransducer(tokenizer_path("byte_bpe_50k.json"), max_states=50)
    texts = ["".join(RNG.choice("abc dé'st\n1") for _ in range(RNG.randrange(2500))) for _ in range(30)] + ["q" * 3000]
    for _ in range(2):
        _, got = counts.count_batch(machine, pa.array(texts))
        assert got.tolist() == [len(e.ids) for e in machine.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_id_table(name):
    table = token_ids.IdTable(tokenizer_path(name), size=40)
    texts = TEXTS + ["".join(RNG.choice(" \n\té'sab1.  ") for _ in range(20)) for _ in range(2000)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in table.encode(texts)]
        assert got == [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_id_table_by_ranks(name):
    """Every token of the vocabulary as a text and as a unit, white space of all kinds beside cuts, tables of all sizes."""
    name = tokenizer_path(name)
    table = token_ids.IdTable(name)
    assert table.ranked is not None
    texts = [token.removesuffix("</w>") for token in table.library.get_vocab()] + [table.library.decode([i]) for i in range(table.library.get_vocab_size())]
    texts.append(" ".join(texts))
    white = ["", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]
    texts += ["".join(RNG.choice(white) + RNG.choice(["a", "'s", "é", "1", "!", "Ω", ""]) + RNG.choice(["", " "]) for _ in range(12)) for _ in range(4000)]
    want = [e.ids for e in table.library.encode_batch(texts, add_special_tokens=False)]
    for size, held in ((500_000, 64 << 20), (50, 64 << 20), (500_000, 100)):
        table = token_ids.IdTable(name, size=size)
        table.columns.held_bytes = held
        got = [x for at in range(0, len(texts), 700) for x in table.encode(texts[at : at + 700])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert table.encode([]) == []


def test_pieces_of_a_small_table():
    texts = ["", " ", "the  cat", *(f"word{k % 37} und W\u00f6rter{k} {k * k}\u2581x \U0001f600" for k in range(400))]
    path = tokenizer_path("piece_bpe_32k.model")
    for table in (pieces.ChunkTable(path, table_size=40), pieces.ChunkTable(path, table_chars=300), pieces.ChunkTable(path, table_size=900)):
        for at in range(0, len(texts), 50):
            part = texts[at : at + 50]
            assert [np.frombuffer(x, np.int32).tolist() for x in table.encode(part)] == table.model.encode(part)
            assert len(table.older) <= table.size
    lists = pa.array([[5, 6], None, [], [7]], pa.list_(pa.int32()))
    assert list(pieces._rows(lists.slice(1))) == [[], [], [7]] and list(pieces._rows(lists)) == [[5, 6], [], [], [7]]


def test_pieces(docs):
    model = pieces.table_for(tokenizer_path("piece_bpe_32k.model")).model
    got = {r["id"]: (r["ids"], r["decoded"]) for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    assert got == {i: ((e := model.encode(t)), model.decode(e)) for i, t in texts_by_id().items()}
    assert pieces.decode_pieces(pieces.encode_pieces(empty(docs))).count() == 0


def brute_cost(ends, penalties, length):
    places, cost = [0, *ends], [0.0]
    for j in range(1, len(places)):
        sizes = [(i, places[j] - places[i]) for i in range(j)]
        cost.append(penalties[j - 1] + min(cost[i] + (0 if s & (s - 1) == 0 and s >= 32 else length - s) for i, s in sizes if s <= length))
    return cost[-1]


def test_cuts_are_optimal():
    for _ in range(40):
        ends = np.cumsum([RNG.randrange(1, 40) for _ in range(60)])
        penalties = np.asarray([RNG.choice([0, 2, 9]) for _ in ends], np.float32)
        cuts = packing.choose_cuts(ends, penalties, 128)
        total, at = 0, 0
        for c in cuts:
            size = c - at
            assert 0 < size <= 128
            total += (0 if size & (size - 1) == 0 and size >= 32 else 128 - size) + penalties[list(ends).index(c)]
            at = c
        assert at == ends[-1] and total == brute_cost(ends.tolist(), penalties.tolist(), 128)


def test_packing(docs):
    table = token_ids.IdTable(tokenizer_path("word_bpe_49k.json"))
    expected = {i: np.append(np.frombuffer(table.encode([t])[0], "<u4"), 2).tolist() for i, t in texts_by_id().items()}
    for length in (64, 4096):
        rows = packing.pack_documents(docs, length=length).orderBy("sequence_id", "offset").collect()
        rebuilt, used = {}, {}
        for r in rows:
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["offset"] == used.get(r["sequence_id"], 0) and len(ids) == r["length"] and r["doc_tokens"] == len(expected[r["id"]])
            used[r["sequence_id"]] = r["offset"] + r["length"]
            rebuilt.setdefault(r["id"], []).append((r["start"], ids))
        assert max(used.values()) <= length
        assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in rebuilt.items()} == expected
    assert packing.pack_documents(empty(docs)).count() == 0


def test_stretches_of_the_stream_are_carried():
    packer = packing.Packer(np.asarray([5]), 7, length=64, horizon=200)
    outs, ids = [], {}
    for d in range(40):
        ids[d] = np.asarray([RNG.randrange(10) for _ in range(RNG.randrange(1, 150))], np.uint32)
        packer.add(d, ids[d])
        if packer.full():
            outs.append(packer.pack(False))
    outs.append(packer.pack(True))
    got = {}
    for doc, start, size, whole, sequence, offset, data, bounds in filter(None, outs):
        for k, d in enumerate(doc):
            assert whole[k] == len(ids[d]) and start[k] == len(got.get(d, []))
            got.setdefault(d, []).extend(data[bounds[k] - size[k] : bounds[k]].tolist())
    assert got == {d: x.tolist() for d, x in ids.items()}


def test_range_coder():
    for n, top in ((0, 9), (1, 9), (7, 50257), (130, 3), (3000, 50257), (20000, 40)):
        ids = np.asarray([RNG.randrange(top) for _ in range(n)], np.uint32)
        block = range_coder.encode_block(ids, 50257)
        assert (range_coder.decode_block(block) == ids).all()
    for at in (len(block) - 1, 10, 40):
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises(range_coder.CorruptBlock):
            range_coder.decode_block(bytes(bad))


def test_id_files(spark, docs):
    table = token_ids.IdTable(tokenizer_path("byte_bpe_50k.json"))
    expected, start = [], 0
    for i, t in sorted(texts_by_id().items()):
        raw = table.encode([t])[0] + np.uint32(2).tobytes()
        expected.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    for block in (16, 1 << 20):
        path = id_files.new_path(spark)
        id_files.write_ids(docs, path, block_ids=block)
        rows = id_files.document_checksums(id_files.read_pieces(spark, path)).orderBy("id").collect()
        assert [tuple(r) for r in rows] == expected
    a, b = b"some bytes", b"and more of them"
    assert id_files.combine_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be <b>"), (2, 0, "system", "s"), (3, 0, None, None)]
    rows += [(2, k, "assistant" if k % 2 else "user", prose(RNG.randrange(60))) for k in range(1, 50)]
    rows += [(3, 1, "assistant", "twice"), (3, 1, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, budget=300, history=80)
    shown = windows.collect()
    assert sum(w["conv"] == 2 for w in shown) > 3
    for w in shown:
        turns = chat.parse_window(w["text"])
        assert sum(not again for _, again, _ in turns) == w["new_turns"] and sum(again for _, again, _ in turns) == w["again_turns"]
        assert w["tokens"] <= 300 or w["new_turns"] == 1
        assert w["conv"] != 2 or turns[0][0] == "system"
    got = {r["conv"]: r for r in chat.conversation_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(empty(df))).count() == 0


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)] + [(RNG.randrange(300, 400), RNG.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = brute_components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got == expected


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * 0.12).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    odd = [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, []), (305, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(df, miss=1e-6, block=40).collect()}
    v = np.asarray([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    close = v @ v.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    roots = brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    expected = {i: (int(close[k].sum()), roots[i]) for k, i in enumerate(ids)} | {i: (0, i) for i, _ in odd}
    assert got == expected
    assert embeddings.link_vectors(empty(df)).count() == 0


def test_near_duplicates(spark):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[RNG.choice(vocabulary) for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(120):
        words = list(base[i % 8])
        for _ in range(RNG.randrange(3)):
            words[RNG.randrange(60)] = RNG.choice(vocabulary)
        rows.append((i, " ".join(words).title() if i % 5 else "  ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one  TWO"), (505, "one two three"), (506, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = brute_components(sets, linked)
    for block in (512, 5):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, words=4, orders=24, block=block).collect()}
        assert got == {i: (len(s), roots[i]) for i, s in sets.items()}
    assert minhash.near_duplicates(empty(df)).count() == 0
    assert not shingles.similar(np.zeros(0, np.uint64), np.zeros(0, np.uint64), 80)


def brute_removed(texts, width):
    seen, out = set(), {}
    for key, text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if raw[s : s + width] in seen:
                gone[s : s + width] = True
            seen.add(raw[s : s + width])
        out[key] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def test_repeats(spark):
    letters = "abcdefgé 日"
    passage = "".join(RNG.choice(letters) for _ in range(400))
    texts = [(i, "".join(RNG.choice(letters) for _ in range(RNG.randrange(200))) + passage[a : a + n] + "".join(RNG.choice(letters) for _ in range(RNG.randrange(90)))) for i in range(40) for a, n in [(RNG.randrange(200), RNG.randrange(220))]]
    line = "".join(RNG.choice(letters) for _ in range(60))  # one line in many surroundings, some of them shared
    texts += [(100 + i, "".join(RNG.choice("ab") for _ in range(90)) + line[: RNG.randrange(40, 61)] + passage[: RNG.choice([0, 20, 45])] + "".join(RNG.choice("cd") for _ in range(90))) for i in range(60)]
    texts += [(50, "ab" * 300), (51, "x" * 450), (52, None), (53, ""), (54, texts[3][1]), (55, texts[3][1][:99])]
    # lines that repeat with a period, cut anywhere: anchors that stand in several places of a stretch
    beat = [(line[:30] * 12, line[5:14] * 40, "xy" * 150 + line[:7])[i % 3] for i in range(45)]
    texts += [(200 + i, "".join(RNG.choice("pq") for _ in range(RNG.randrange(40))) + b[RNG.randrange(40) : RNG.randrange(150, 330)] + "".join(RNG.choice("rs") for _ in range(RNG.randrange(60)))) for i, b in enumerate(beat)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for block in (3000, 4, 1):
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, block=block, shard_bytes=4000).collect()}
        assert got == brute_removed(texts, 100)
    twice = spark.createDataFrame([(None, "q" * 120), (1, passage), (1, passage)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.remove_repeats(twice).collect()) == sorted([119, 0, len(passage.encode())])
    assert repeats.remove_repeats(empty(df)).count() == 0


def test_fingerprints(spark, docs):
    got = {r["id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    ordered = sorted(texts_by_id().items())
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        tail = len(text) // 4
        assert got[i]["n_chars"] == len(text) and got[i]["edited"] == text[: len(text) - tail] + after[:tail]
        assert got[i]["fingerprint"] == fingerprints.to_string(fingerprints.sketch(text)) and 0 <= got[i]["near_next"] <= 1
    one = spark.createDataFrame([(None, "abcd")], "doc_id long, text string")
    assert fingerprints.compare_with_next(one).first()["edited"] == "abca"
    assert fingerprints.compare_with_next(empty(docs)).count() == 0
    big = "".join(chr(RNG.randrange(97, 123)) for _ in range(40000))
    small, half = fingerprints.sketch(big[:4000]), fingerprints.sketch(big[2000:])
    assert fingerprints.containment(small, fingerprints.sketch(big)) == 1.0
    assert abs(fingerprints.containment(small, half) - 0.5) < 0.15
    assert (fingerprints.merge(fingerprints.sketch(big[:9000]), fingerprints.sketch(big[8989:])) == fingerprints.sketch(big)).all()
    assert (fingerprints.from_string(fingerprints.to_string(small)) == small).all()


def test_language(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "shore", "king", "with"], "fr": ["leau", "été", "queue", "vous"], "de": ["über", "schön", "der", "ung"], "es": ["señor", "ción", "para", "los"]}
    say = lambda l, n: " ".join(rng.choice(stems[l]) + rng.choice(["", "s", "en"]) for _ in range(n))
    rows = [(i, say(l, 30), l, f"host{l}") for i, l in enumerate(["en", "fr", "de", "es"] * 60)]
    odd = [(900, None, "en", "h"), (901, "", None, None), (902, "123 !!", "en", "h"), (903, say("fr", 40), "xx", None), (904, "шщэ юяж " * 40, None, "h"), (905, say("de", 40), "en", "hosten")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumn("language", F.lit("clash"))
    model = language.fit_text_model(df, sample=30)
    for limit in (20_000, 0):
        got = {r["doc_id"]: r for r in language.identify_languages(df, model, broadcast_hosts=limit).collect()}
        assert len(got) == len(rows) + len(odd)
        assert all(got[i]["language"] == l and not got[i]["rejected"] for i, _, l, _ in rows)
        assert [got[i]["rejected"] for i in (900, 901, 902, 903, 904, 905)] == [True, True, True, False, True, False]
        assert got[903]["language"] == "fr" and got[905]["language"] == "de"
    held_out = spark.createDataFrame([(i, say(l, 12), None, None, l) for i, l in enumerate(["en", "fr", "de", "es"] * 50)], "doc_id long, text string, lang string, source string, truth string")
    assert language.identify_languages(held_out, model).where("language = truth").count() >= 196
    page = spark.createDataFrame([(1, "https://u@A.example.org:80/x", '<html lang="FR-ca"><script>var a="<p>"</script><p>caf&eacute; &#33;</p>')], "page_id long, url string, html string")
    row = language.page_evidence(page).first()
    assert (row["host"], row["suffix"], row["declared"], row["text"].split()) == ("a.example.org", "org", "fr", ["café", "!"])
