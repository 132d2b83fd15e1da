"""BPE, token files and token counts against the tokenizers' own libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chargeloom.llm import bpe, tokenfile, unigram
from chargeloom.llm.queries import op3_bpe, op6_tokenfile, op10_unigram

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts(seed=1, many=250):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "Étude", "'s", "'LL", "12", "<|endoftext|>", "<|startoftext|>", "!?.", "\t", "　", "日本", "Ж", "\x1c", "\xa0", "é", "Σ", "İ", "😀", "ing", "\r\n", "\x00"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(many)]
    return [*out, "", None, " ", "  lead", "trail  ", "x" * 3000, "!" * 2500, "ab" * 40_000, " ".join(["word"] * 30_000), "same", "same"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")


def test_word_bpe_is_the_librarys(spark, table):
    library = Tokenizer.from_file(WORD)
    rows = bpe.decode_documents(bpe.encode_documents(table, WORD), WORD).withColumn("ids", F.col("ids")).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_op3_query(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(WORD)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_bpe(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_transducer_holds_little_and_changes_nothing():
    tokenizer = bpe.load(WORD)
    rng = random.Random(4)
    common = "the of and ing tion er est re in on th ate".split()
    for n in (1, 5, 200, 3000):
        for make in (lambda: rng.choice("abcdefgh"), lambda: rng.choice(common), lambda: "a"):
            raw = "".join(make() for _ in range(n)).encode()
            symbols = [tokenizer.inner[b] for b in raw]
            symbols[-1] = tokenizer.last[raw[-1]]
            stream, out, most = bpe.Transducer(tokenizer.merges), [], 0
            for s in symbols:
                out += stream.feed([s])
                most = max(most, len(stream.held))
            out += stream.finish()
            assert out == tokenizer.merges.apply(symbols)
            assert most <= stream.room


def test_merge_runs_agree_and_order_is_checked():
    merges = bpe.load(WORD).merges
    rng = random.Random(5)
    for _ in range(100):
        symbols = [rng.choice(bpe.load(WORD).inner[97:123]) for _ in range(rng.randrange(1, 150))]
        assert merges._long(symbols) == merges._short(list(symbols))
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    # (b, c) is taken before (a, b) can be: two symbols decide about the boundary before b.
    assert bpe.Merges({"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, [("b", "c"), ("a", "b")]).lookahead() == 2


def test_decoder_state_machine(spark):
    tokenizer = bpe.load(WORD)
    ids = np.frombuffer(tokenizer.encode("Grüße, 日本 😀 x"), np.int32).tolist()
    for form in ("text", "surface"):
        machine = bpe.Decoder(tokenizer.surfaces, tokenizer.pieces, form)
        assert "".join(machine.feed([i]) for i in ids) + machine.finish() == tokenizer.decode(ids, form)
    assert tokenizer.decode(ids, "text") == "grüße , 日本 😀 x "
    half = [i for i in range(512) if tokenizer.pieces[i] == b"\xc3"][:1]
    assert tokenizer.decode(half, "text") == "�"
    rows = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_documents(rows, WORD).collect()] == [None, ""]


def test_empty_tables(spark, table):
    none = table.limit(0)
    assert bpe.encode_documents(none, WORD).count() == 0 and unigram.count_tokens(none, PIECE).count() == 0


def library_rows():
    library, start, out = Tokenizer.from_file(BYTE), 0, []
    for i, text in enumerate(texts()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op6_query(spark, table, tmp_path):
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in op6_tokenfile(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == library_rows()


def test_token_store(spark, table, tmp_path):
    folder = str(tmp_path / "store")
    tokenfile.write_tokens(table, folder, BYTE, block_bytes=2_000)
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    assert dictionary.width == 2 and (not dictionary.dictionary or hashlib.sha256(dictionary.dictionary).hexdigest() == dictionary.dict_hash)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 3 and {r.dict_hash for r in blocks.select("dict_hash").collect()} == {dictionary.dict_hash}
    one = tokenfile.read_tokens(spark, folder, doc_id=17).collect()
    library = Tokenizer.from_file(BYTE)
    assert [list(r["ids"]) for r in one] == [[*library.encode(texts()[17], add_special_tokens=False).ids, 2]]
    spark.createDataFrame([("other", b"", 2)], "dict_hash string, dictionary binary, width int").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        tokenfile.read_tokens(spark, folder).collect()


def test_token_store_with_odd_ids(spark, tmp_path):
    rows = spark.createDataFrame([(None, "n"), (5, "b"), (5, "b"), (-3, "a"), (None, None)], "doc_id long, text string")
    tokenfile.write_tokens(rows, f"{tmp_path}/s", BYTE)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_tokens(spark, f"{tmp_path}/s").collect())
    assert [x[1] for x in got] == [None, None, -3, 5, 5] and [x[0] for x in got] == np.cumsum([0, *[x[2] for x in got[:-1]]]).tolist()
    tokenfile.write_tokens(rows.limit(0), f"{tmp_path}/e", BYTE)
    assert tokenfile.read_tokens(spark, f"{tmp_path}/e").count() == 0


def brute_unigram(pieces, unknown, text):
    """Best score and count by plain dynamic programming over the whole text; ties to the earliest start."""
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            word = text[start:end]
            options = [(pieces[word], 1)] if word in pieces else [(unknown, len(word.encode()))] if len(word) == 1 else []
            for score, n in options:
                total = (best[start][0] + score, best[start][1] + n)
                if best[end] is None or total[0] > best[end][0]:
                    best[end] = total
    return best[-1]


def test_unigram_against_brute_force(spark, tmp_path):
    counter = unigram.load(PIECE)
    pieces = {k: v[1] for k, v in counter.automaton.items()}
    rows = [(i, t) for i, t in enumerate(texts(9, 120)) if t is None or len(t) < 4000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.score, r.n_tokens) for r in op10_unigram(spark, str(tmp_path)).collect()}
    for i, text in rows:
        assert got[i] == (brute_unigram(pieces, counter.unknown, "▁" + text.replace(" ", "▁")) if text else (0.0, 0))


def test_unigram_is_the_librarys_where_its_floats_are_exact():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECE, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # scores of -1e9 leave a 32-bit float nothing for the others
        p.score = max(p.score, -40_000)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    counter = unigram.Counter(PIECE)
    counter.build({p.piece: p.score for p in model.pieces if p.type in (1, 4)})
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ABC.,'12éè\n日😀 the and ") for _ in range(rng.randrange(0, 60)))
        tokens = library.encode(text)
        assert counter.count([text])[0][0] == len(tokens), text


def test_unigram_counts_are_the_librarys_on_the_given_file():
    import sentencepiece

    library, counter = sentencepiece.SentencePieceProcessor(model_proto=unigram.as_unigram(PIECE)), unigram.load(PIECE)
    rng = random.Random(6)
    parts = ["the ", " ", "  ", "\n", "日本", "é", "😀", "ing", "12", "\t", "Ж", "   x", "\x00", "zzzz", "▁"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 300))) for _ in range(400)]
    odd += ["the quick brown fox " * 60_000, "x" * 50_000, *(t or "" for t in texts(12, 200))]
    assert [n for n, _ in counter.count(odd)] == [len(library.encode(t)) for t in odd]


def test_code_points_of_unsettled_blocks_are_cut_as_the_library_cuts():
    library, own = Tokenizer.from_file(WORD), bpe.load(WORD)
    for c in map(chr, [*range(0x20, 0xD800, 7), *range(0xE000, 0x20000, 7)]):
        text = f"a{c}b {c}1 {c}{c}"
        assert np.frombuffer(own.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_rows_of_one_id_are_dealt_over_shards(spark, tmp_path):
    """An id with most rows fills several shards, and the order by id holds."""
    bounds = np.array([5, 7, 7, 7, 9], np.int64)
    rng = np.random.default_rng(1)
    ids, ties = rng.integers(0, 12, 4000), rng.integers(0, 1 << 32, 4000)
    shards = tokenfile._shards(bounds, ids, ties)
    order = np.lexsort((ties, ids))
    assert (np.diff(shards[order]) >= 0).all() and len(set(shards[ids == 7].tolist())) == 4 and set(shards[ids == 3].tolist()) == {0}


def test_one_operator_keeps_things_in_a_worker(monkeypatch):
    from chargeloom.llm import common

    dropped = []
    monkeypatch.setattr(common, "_holder", [])
    common.claim("a", lambda: dropped.append("a"))
    common.claim("a", lambda: dropped.append("again"))
    assert dropped == []
    common.claim("b", lambda: dropped.append("b"))
    common.claim("a", lambda: dropped.append("a2"))
    assert dropped == ["a", "b"]


def test_equal_rows_fill_several_shards():
    """A thousand equal rows over equal bounds are dealt, and the order in which a task reads its rows is all one."""
    from collections import Counter

    bounds, ids = np.array([5, 5, 5, 9], np.int64), np.array([5] * 1000 + [1, 7, 9])
    ties = np.array([123] * 1000 + [5, 6, 7])
    dealt = tokenfile._shards(bounds, ids, ties, Counter())
    counts = np.bincount(dealt[:1000])
    assert len(counts) == 4 and counts.min() > 200 and dealt[1000] == 0 and dealt[1001] == 3 and dealt[1002] in (3, 4)
    order = np.random.default_rng(1).permutation(len(ids))
    again = tokenfile._shards(bounds, ids[order], ties[order], Counter())
    assert sorted(zip(ids, ties, dealt)) == sorted(zip(ids[order], ties[order], again))


def test_counts_under_a_normalizer(tmp_path):
    """Files that drop extra spaces or add none in front are counted as the library counts; others are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    def model(**spec):
        m = proto.ModelProto()
        m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
        for piece, score, kind in [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("▁a", -2.5, 1), ("ab", -4.0, 1), ("▁ab", -5.0, 1), ("▁▁", -6.0, 1)]:
            m.pieces.add(piece=piece, score=score, type=kind)
        for k, v in spec.items():
            setattr(m.normalizer_spec, k, v)
        path = str(tmp_path / "m.model")
        with open(path, "wb") as f:
            f.write(m.SerializeToString())
        return path

    texts = ["", " ", "  ", "a", " a", "  a  b ", "ab ab", "a▁b", "　a", "ba  \n ab", "xab", "ab  ab   "]
    for dummy in (True, False):
        for remove in (True, False):
            path = model(add_dummy_prefix=dummy, remove_extra_whitespaces=remove)
            library = sentencepiece.SentencePieceProcessor(model_file=path)
            assert [n for n, _ in unigram.Counter(path).count(texts)] == [len(library.encode(t)) for t in texts], (dummy, remove)
    m = proto.ModelProto()
    with open(model(), "rb") as f:
        m.ParseFromString(f.read())
    m.pieces.add(piece="zz", score=0.0, type=4)
    with open(tmp_path / "u.model", "wb") as f:
        f.write(m.SerializeToString())
    with pytest.raises(ValueError, match="defined by a user"):
        unigram.Counter(str(tmp_path / "u.model"))


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "ab", "x")], "doc_id long, text string, tokens string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = unigram.count_tokens(rows, path).first()
    assert found.tokens.n_tokens > 0 and found.text == "ab"
    assert unigram.count_tokens(rows.limit(0), path).collect() == []


def test_a_long_word_is_streamed_in_little_memory():
    """A long word has the library's ids, and takes little more than its bytes and its ids."""
    import tracemalloc

    library, own = Tokenizer.from_file(WORD), bpe.load(WORD)
    rng = random.Random(4)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 17))
    short = word[: 1 << 15]
    assert np.frombuffer(own.encode(short), np.int32).tolist() == library.encode(short, add_special_tokens=False).ids
    tracemalloc.start()
    ids = own.encode(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 1 << 17 and peak < 2 << 20
    assert own.decode(np.frombuffer(ids, np.int32).tolist(), "text").strip() == word


def test_cuts_in_two_levels(spark):
    """More shards than one sketch cuts, a third of the rows under one id: shards stay near their size, in order."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 777, cast(pmod(xxhash64(id), 3000) as long)) as doc_id").unionByName(spark.range(40).selectExpr("cast(null as long) as doc_id"))
    bounds = np.array(tokenfile._shard_bounds(rows, "doc_id", shard_docs=50, most_cuts=16), np.int64)
    assert (np.diff(bounds) >= 0).all() and 100 <= len(bounds) <= 160
    ids = np.array([r.doc_id if r.doc_id is not None else np.iinfo(np.int64).min for r in rows.collect()], np.int64)
    ties = np.random.default_rng(3).integers(0, 1 << 32, len(ids))
    shards = tokenfile._shards(bounds, ids, ties)
    order = np.lexsort((ties, ids))
    assert (np.diff(shards[order]) >= 0).all() and np.bincount(shards).max() <= 200
    assert len(set(shards[ids == 777].tolist())) >= 30
    assert tokenfile._shard_bounds(rows.limit(0), "doc_id") == []
