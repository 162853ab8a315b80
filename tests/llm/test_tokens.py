import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import AWKWARD, documents
from tidemark.llm import huffman, packing, tokens, words

ODD = [*"abcXYZ019'.,|<>éÉßøÖÿª½²  \n\t", "́", "İ", "Σ", "ς", "日", "\x1c", "\x85", "😀", "Œ", "×", "<|endoftext|>", "'s", "'LL", "<|"]


@pytest.fixture(scope="module")
def memo():
    return words.WordIds("word_bpe_49k.json")


def ids_of(memo, text):
    return np.frombuffer(memo._library(text or ""), "<u4").tolist()


def test_words_give_the_ids_of_whole_texts(memo):
    r = random.Random(1)
    assert memo.by_word
    for _ in range(600):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 40)))
        assert memo.ids([text.encode()])[0] == memo._library(text)


def test_spliced_chunks_give_the_ids_of_whole_texts(memo):
    r = random.Random(2)
    for space in (3, 0):
        for _ in range(150):
            text = "".join(r.choice(ODD + [" "] * space) for _ in range(r.randint(0, 400)))
            want = ids_of(memo, text)
            assert tokens.spliced_ids(memo, text.encode(), 40, 8) == want
            assert tokens._of_slice(memo, [text.encode(), b"", b"one two"], 40, 8) == [len(want), 0, 2]


def test_counts(spark, memo):
    got = sorted(tokens.token_counts(documents(spark, AWKWARD), chunk=64, overlap=8).collect())
    assert [(g.n_bytes, g.n_tokens) for g in got] == [(len((t or "").encode()), len(ids_of(memo, t))) for t in AWKWARD]
    assert tokens.token_counts(documents(spark, ["a"]).limit(0)).count() == 0


def _check_packing(rows, whole, limit):
    by_sequence = {}
    for p in rows:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    for doc, ids in whole.items():
        own = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in rows if p.doc_id == doc)
        want = [ids[i : i + limit] for i in range(0, len(ids), limit)]
        assert own == [(k, k * limit, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for k, w in enumerate(want)]
    return len(by_sequence)


def test_packing_is_whole_gapless_and_tight(spark, memo):
    r = random.Random(3)
    texts = AWKWARD + ["word " * r.randint(0, 60) for _ in range(200)]
    whole = {i: ids_of(memo, t) + [1] for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts), limit=64).collect()
    used = _check_packing(rows, whole, 64)
    assert used <= -(-sum(map(len, whole.values())) // 64) * 1.05 + 1
    assert packing.pack(documents(spark, ["a"]).limit(0)).count() == 0


def test_plan_places_every_rank_once():
    r = random.Random(5)
    for _ in range(40):
        histogram = {n: r.randint(1, 50) for n in r.sample(range(1, 65), r.randint(1, 40))}
        table, opened = packing.plan(histogram, 64)
        room, counts = [0] * opened, dict.fromkeys(histogram, 0)
        for length, rank, wide, first, offset in table.tolist():
            following = [x for x in table.tolist() if x[0] == length and x[1] > rank]
            end = following[0][1] if following else histogram[length]
            for k in range(rank, end):
                copy, place = divmod(k - rank, wide)
                assert offset + copy * length + length <= 64
                room[first + place] += length
                counts[length] += 1
        assert counts == histogram and max(room) <= 64


@pytest.mark.parametrize("n", [1, 2, 5, 300, 20_000])
def test_codes_are_optimal_length_limited_and_decode(n):
    r = np.random.default_rng(n)
    counts = r.zipf(1.3, n).astype(np.int64) % 100_000 + 1
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.MAX_BITS and (n == 1 or abs(np.sum(2.0 ** -lengths.astype(float)) - 1) < 1e-9)
    bits = int(lengths.max())
    ids, ends = r.integers(0, n, 5000).astype("<u2"), np.array([0, 1, 700, 700, 5000])
    data, _, places = huffman.encode_bits(ids, ends, huffman.canonical(lengths), lengths)
    counts_ = np.diff(np.concatenate([[0], ends]))
    full = counts_ > 0
    back = huffman.decode_runs(np.frombuffer(data, np.uint8), 8 * places[:-1][full], counts_[full], huffman.decode_table(lengths, bits), bits)
    assert (back == ids).all()


def test_length_limit_costs_little_and_holds():
    counts = np.array([1 << k for k in range(30)], np.int64)
    assert huffman.code_lengths(counts, 6).max() == 6


def test_files_round_trip(spark, memo, tmp_path):
    texts = AWKWARD + ["Some words, again and again. " * k for k in range(40)]
    huffman.write_ids(documents(spark, texts), str(tmp_path / "ids"))
    at = 0
    for i, row in enumerate(sorted(huffman.read_ids(spark, str(tmp_path / "ids")).collect())):
        want = ids_of(memo, texts[i]) + [1]
        assert (row.id, row.start, row.n_tokens, row.ids) == (i, at, len(want), want)
        at += len(want)
    huffman.write_ids(documents(spark, ["a"]).limit(0), str(tmp_path / "none"))
    assert huffman.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_null_repeated_and_large_doc_ids(spark, memo, tmp_path):
    rows = [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), ((1 << 53) + 1, "large"), (-(1 << 62), "small")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    huffman.write_ids(docs, str(tmp_path / "ids"))
    got = huffman.read_ids(spark, str(tmp_path / "ids")).collect()
    lists = sorted((str(i), *ids_of(memo, t), 1) for i, t in rows)
    assert sorted((str(g.id), *g.ids) for g in got) == lists
    starts = sorted((g.start, g.n_tokens) for g in got)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))
    packed = packing.pack(docs, limit=8).collect()
    assert len(packed) == len(rows)


def test_ids_above_sixteen_bits(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(0, "ab"), (1, ""), (2, "abc")], "doc_id long, text string")
    batch = pa.record_batch([pa.array([0, 1, 2]), pa.array([3, 1, 2]), pa.array([np.array([70_000, 3, 1], "<u4").tobytes(), np.array([1], "<u2").tobytes(), np.array([5, 1], "<u2").tobytes()], pa.binary())], ["id", "n", "ids"])
    assert huffman.flat_ids(batch)[0].tolist() == [70_000, 3, 1, 1, 5, 1]
    rows = spark.createDataFrame([(0, 4, bytearray(np.array([70_002, 3, 130_000, 1], "<u4").tobytes())), (1, 1, bytearray(np.array([1], "<u2").tobytes()))], "id long, n long, ids binary")
    monkeypatch.setattr(huffman, "tokenized", lambda *a: rows)
    huffman.write_ids(docs, str(tmp_path / "wide"))
    assert [r.ids for r in sorted(huffman.read_ids(spark, str(tmp_path / "wide")).collect())] == [[70_002, 3, 130_000, 1], [1]]


def test_a_full_memo_keeps_what_comes_up_again(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import words

    memo, computed = words.WordIds("word_bpe_49k.json", most_words=3), []
    monkeypatch.setattr(memo.pieces, "of", lambda piece: computed.append(piece) or memo._piece(piece))
    texts = ["Often, word$$$ often... éa!! l'eau, o'clock's 12. <|x|>,", "more (words) &&& a*** Often! ß,;: x'# 'll. it's%%%", "end.) ## often."]
    for text in [*texts, *texts[::-1]]:
        ids, ends = memo.encoded(pa.array([text.encode()], pa.binary()))
        assert ids.tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids and ends.tolist() == [len(ids)]
    before = len(computed)
    for _ in range(3):
        memo.encoded(pa.array([texts[0].encode()], pa.binary()))
    assert len(computed) - before <= 9 and computed.count("often") == 1
