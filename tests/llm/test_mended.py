"""Hot anchors, clashing column names, and tokenisers that differ from the model's own library."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sectiva.llm import line_dedup, near_dup, pieces, substring_dedup
from tests.llm.data import SCHEMA, frame, sentence
from tests.llm.test_dedup import brute_substrings


def test_a_hot_anchor_is_found_and_spread(spark, monkeypatch):
    """A footer that every document holds is seen in the sample of documents; results stay those of brute force."""
    rng = random.Random(5)
    footer = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(99)) for _ in range(40))[:240]
    rows = [(i, f"{rng.random()} {sentence(6)} {footer}{rng.random()}", "en", "s", 1) for i in range(3000)]
    docs = frame(spark, rows)
    keyed = substring_dedup._keyed(docs, "doc_id", "text")
    assert keyed.filter("tkey <> 0").count() == 0, "ids are unique"
    found = substring_dedup.frequent_anchors(keyed, substring_dedup.ROW.format("bigint"))
    assert found
    anchored = keyed.mapInArrow(substring_dedup._anchor_rows, substring_dedup.ROW.format("bigint")).filter(F.col("h").isin(found))
    assert anchored.select("c").distinct().count() > 500, "its contexts are dealt by their bytes, not by the anchor"
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_substrings(rows)


def test_near_duplicate_stage_keeps_columns_of_any_name(spark):
    text = sentence(80)
    rows = [(1, text, "a", 7, "x", 1), (2, text, "b", 8, "y", 2), (3, sentence(80), "c", 9, "z", 3), (3, rows_text := sentence(90), "d", 1, "q", 4), (3, rows_text, "d", 1, "p", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row_key string, _gone_id bigint, _gone_key string, row int")
    got = sorted((tuple(r) for r in near_dup.keep_one_per_group(df).collect()), key=lambda r: (r[0], r[5]))
    assert got == [rows[0], *sorted([rows[2], rows[4]], key=lambda r: r[5])]
    assert near_dup.keep_one_per_group(df).columns == df.columns


def test_line_stage_keeps_columns_of_any_name(spark):
    rows = [(i, f"{sentence(8)} {i}\nfooter", "en", "s", 5, -i, "kept") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", _n_lines int, N_DROPPED string")
    assert line_dedup.spare(df, "n_lines", "n_dropped") == ("n_lines", "n_dropped_")
    got = corpus_pipeline.line_dedup(spark, df, "").collect()
    assert {(r._n_lines, r.N_DROPPED) for r in got} == {(-i, "kept") for i in range(40)}
    assert all("footer" not in r.text and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("sample", [True, False])
def test_a_tokeniser_that_differs_gives_the_librarys_ids(spark, monkeypatch, sample):
    """No difference ends the run: of the sample, the library encodes everything; of a row in a batch, that batch."""
    docs = frame(spark)
    want = {(r.doc_id, tuple(r.ids), r.restored) for r in pieces.encode_documents(docs).collect()}
    monkeypatch.setattr(pieces, "differs", lambda *a: "differs")
    if not sample:
        monkeypatch.setattr(pieces, "verify_parity", lambda *a: (1, 0))
    assert {(r.doc_id, tuple(r.ids), r.restored) for r in pieces.encode_documents(docs).collect()} == want
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_pieces_that_stand_for_themselves_are_not_decoded():
    from sectiva.llm import pieces as p

    with open(p.MODEL_PATH, "rb") as f:
        own = p.Pieces(f.read())
    asked, real = [], own.tokenizer
    own.tokenizer = type("Counted", (), {"encode_batch_fast": staticmethod(real.encode_batch_fast), "decode_batch": staticmethod(lambda ids, **kw: asked.extend(ids) or real.decode_batch(ids, **kw))})
    texts = ["plain words, plain lines", "", "byte \U0001f9ff\x07 pieces", "a  b", "<0x41>"]
    ids, ends, sound = own.encode(texts)
    assert len(asked) < len(own.memo) / 2
    back = real.decode_batch([ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], skip_special_tokens=False)
    assert all(b[1:] == t for b, t, s in zip(back, texts, sound, strict=True) if s) and sound[[0, 1, 2]].all()


def test_segments_share_texts_of_a_call_and_give_the_librarys_ids():
    """op4: the library is asked for far fewer texts than there are segments; runs of blanks, bytes and empty texts come out as its own encoding."""
    with open(pieces.MODEL_PATH, "rb") as f:
        blob = f.read()
    own, theirs = pieces.Pieces(blob), pieces.reference(blob)
    asked, real = [], own.tokenizer
    own.tokenizer = type("Counted", (), {"encode_batch_fast": staticmethod(lambda texts, **kw: asked.extend(texts) or real.encode_batch_fast(texts, **kw)), "decode_batch": staticmethod(real.decode_batch)})
    texts = [" ".join(f"word{i * 7 + k:x}" for k in range(7)) for i in range(600)]
    texts += [None, "", "   ", " a   b ", "x  ", "\u2581", "a\u2581 b\u2581\u2581 c", "\x00\x07 \U0001f9ff\n\n 12\t34", "<0x41> <s>", "\u65e5\u672c\u8a9e" * 40] * 3
    ids, ends, sound = own.encode(texts)
    assert len(asked) < len(own.memo) / 50
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == theirs.encode(t or "")
        assert sound[k] == ("\u2581" not in (t or ""))


def test_batches_encoded_together_give_each_its_own_rows(monkeypatch):
    import pyarrow as pa

    with open(pieces.MODEL_PATH, "rb") as f:
        blob = f.read()
    own, theirs = pieces.Pieces(blob), pieces.reference(blob)
    texts = [["the same words", "", None], [], ["the same words  again"], [None], ["other words", "the same"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x, pa.string())], names=["doc_id", "text"]) for x in texts]
    for most, rebuilt in ((1, True), (30, True), (1 << 24, True), (1 << 24, False)):
        monkeypatch.setattr(pieces, "TOGETHER", most)
        got = list(pieces._encode(iter(batches), blob, own, rebuilt))
        assert [b.column(2).to_pylist() for b in got] == [[theirs.encode(t or "") for t in x] for x in texts]
        assert [b.column(0).to_pylist() for b in got] == [list(range(len(x))) for x in texts]
        assert [b.column(1).to_pylist() for b in got] == [[len(theirs.encode(t or "")) for t in x] for x in texts]
        assert all(all(b.column(3).to_pylist()) for b in got)


def test_unknown_characters_are_one_piece_across_segments_ends():
    """op4: without byte pieces a run of unknown characters is one piece, as in the model format's own library."""
    from tests.llm.test_scans import written_model

    known = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("ab", -3.0, 1), ("\u2581a", -4.0, 1), ("\u2581", -30.0, 1), ("a", -31.0, 1), ("b", -32.0, 1)]
    for kind in (pieces.BPE, pieces.UNIGRAM):
        blob = written_model(known, kind, byte_fallback=False, squeeze=False)
        own, theirs = pieces.Pieces(blob), pieces.reference(blob)
        texts = ["ab  ab", "..,, ab", "a\n\n5 b", "", "\u65e5. a"]
        ids, ends, _ = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [theirs.encode(t) for t in texts]


def test_kernel_sees_each_compared_form_once():
    from sectiva.llm import toxicity as t

    m = t.train([{"grubel", "haus"}, {"grubel", "baum"}, {"haus"}, {"baum"}], [1, 1, 0, 0])
    asked, kernel = [], m.kernel
    m.kernel = lambda words: asked.extend(words) or kernel(words)
    got = m.decide(["haus", "haus,", "(haus)", "grubel", "gr.ubel", ""])
    assert len(asked) == len(set(asked))
    assert got[0] == got[1] == got[2] and got[3] <= got[4] + 1e-9
