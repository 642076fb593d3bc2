from pyspark.sql import functions as F
import numpy as np
import pyarrow as pa

from scholia.llm import substring_dedup as S
from scholia.llm.textvec import text_buffer
from tests.llm.helpers import words


def plain_chunks(text):
    """The chunks of one text by the rolling form of the hash."""
    b = text.encode()
    cuts, h, word, n = [], 0, False, 0
    for i, c in enumerate(b):
        white = c == 32 or 9 <= c <= 13
        if not white and not word:
            if not cuts or (h & 0xFFFF) < int(S._LIMIT) and i >= 16 or n == S.MAX_WORDS:
                cuts.append(i)
                n = 0
            n += 1
        word = not white
        # 16 shifts push a byte out of 16 bits
        h = ((h << 1) + int(S._GEAR[c])) & 0xFFFF
    out = []
    for a, z in zip(cuts, cuts[1:] + [len(b)]):
        out.append(b[a:z].rstrip(b" \t\n\x0b\x0c\r"))
    return out


def test_chunks_follow_the_rolling_hash():
    texts = [" ".join(words(300, 1)), "Der " * 200, "", "é ü\nñ  x" * 40, "one", " \n "]
    buf, off = text_buffer(pa.array(texts))
    begin, end, doc, n = S.chunk_bounds(buf, off)
    for i, t in enumerate(texts):
        own = [buf[a:z].tobytes() for a, z in zip(begin[doc == i], end[doc == i])]
        assert own == plain_chunks(t), t[:20]
    assert n.sum() == sum(len(t.split()) for t in texts)


def passages(spark):
    shared = " ".join(words(70, 99))
    short = " ".join(words(12, 98))
    rows = [(i, " ".join(words(80, i)) + "\n" + (shared if i % 3 == 0 else short) + " " + " ".join(words(50, 500 + i))) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "  \n"), (None, rows[0][1]), (53, rows[1][1])]
    return rows, shared, short


def test_repeats_go_from_all_places_but_the_first(spark):
    rows, shared, short = passages(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.substring_dedup(df).collect() if r.doc_id is not None}
    assert len(got) == len(rows) - 1
    assert got[0].n_cut == 0 and shared in got[0].text
    for i in (3, 6, 9):
        assert shared not in got[i].text and got[i].n_cut > 0.7 * len(shared)
        # the rest of the text is untouched at both ends
        assert got[i].text.startswith(rows[i][1][:200]) and got[i].text.endswith(rows[i][1][-200:])
    for i in (1, 2, 4, 5):
        assert got[i].text == rows[i][1] and got[i].n_cut == 0
    assert got[53].text.strip() == "" and got[50].text is None and got[51].text == ""
    spans = S.repeated_passages(df).collect()
    assert {r.doc_id for r in spans} == {3, 6, 9, 53}
    text = dict(rows)
    for r in spans:
        assert text[r.doc_id][r.begin : r.end] in text[r.first_doc_id] or r.doc_id == 53


def test_chunks_that_never_occurred_together_are_no_passage(spark):
    # each chunk of the last text came before, but each in another document
    text = " ".join(words(80, 5))
    alone = [c.decode() for c in plain_chunks(text)]
    cut = [0]
    for c in alone:
        cut.append(text.index(c, cut[-1]) + len(c))
    rows = [(i, " ".join(words(30, 700 + i)) + text[max(0, cut[i] - 20) : cut[i + 1]] + text[cut[i + 1] :][:20] + " " + " ".join(words(30, 900 + i))) for i in range(len(alone))]
    rows.append((1000, text))
    window = lambda t: {" ".join(t.split()[i : i + S.MIN_WORDS]) for i in range(len(t.split()) - S.MIN_WORDS + 1)}
    before = set().union(*(window(t) for i, t in rows if i < 1000))
    assert not window(text) & before
    assert S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    # a passage is found in the same place as a plain search of word windows finds it
    rows = [(1, text), (2, " ".join(words(40, 6)) + " " + text + " " + " ".join(words(40, 7)))]
    (r,) = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert window(rows[1][1][r.begin : r.end]) <= window(text) and r.n_words == len(rows[1][1][r.begin : r.end].split()) >= 60


def test_insertions_shift_nothing():
    ws = words(400, 3)
    a = set(plain_chunks(" ".join(ws)))
    b = set(plain_chunks(" ".join(["new"] * 3 + ws[:200] + ["inserted"] + ws[200:])))
    assert len(a & b) >= len(a) - 6


def test_empty_and_clashing(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(words(60, 4))
    df = spark.createDataFrame([(1, t, 5, "q"), (2, t, 6, "r")], "doc_id long, text string, n_cut int, digest string")
    got = {r.doc_id: r for r in S.substring_dedup(df).collect()}
    assert got[1].text == t and got[2].n_cut == len(t) and got[2].digest == "r"


def test_repeated_rows_and_clashing_columns(spark):
    shared = " ".join(words(23, 31))
    rows = [(1, " ".join(words(40, 1)) + " " + shared), (2, shared + " " + " ".join(words(40, 2)))]
    # a row that comes twice adds nothing to what repeats
    once = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    twice = S.repeated_passages(spark.createDataFrame(rows + rows[1:] * 3, "doc_id long, text string")).collect()
    assert sorted(once) == sorted(twice)
    # two texts of one id are cut each by its own passages
    long = " ".join(words(60, 9))
    a, b = " ".join(words(30, 5)) + " " + long, " ".join(words(90, 6))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, a, 1, 2, 3), (2, b, 1, 2, 3)], "doc_id long, text string, _id int, _spans int, spans int")
    got = {(r.doc_id, r.n_cut > 0): r for r in S.substring_dedup(df).collect()}
    assert got[2, False].text == b and len(got[2, True].text) < len(a) and (got[1, False]._id, got[1, False]._spans, got[1, False].spans) == (1, 2, 3)


def test_multibyte_spans_are_code_points(spark):
    shared = " ".join(w + "é" for w in words(60, 8))
    rows = [(1, "ñ " * 40 + shared), (2, "ü " * 30 + shared + " ß" * 30)]
    spans = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    best = max(spans, key=lambda r: r.n_words)
    assert best.doc_id == 2 and rows[1][1][best.begin : best.end] in shared


def test_gear_window():
    b = np.frombuffer(b"0123456789abcdefXYZ", np.uint8)
    assert S.gear(np.concatenate([b"q" and np.frombuffer(b"qq", np.uint8), b]))[-1] == S.gear(b)[-1]


def test_names_that_clash_but_for_case_or_hold_dots(spark, tmp_path):
    from scholia.llm.mixing import mix

    t = " ".join(words(60, 5))
    df = spark.createDataFrame([(1, t, 5, "q", "s", 9), (2, t, 6, "r", "s", 8)], "doc_id long, text string, N_CUT int, `a.b` string, source string, SLOT int")
    got = S.substring_dedup(df)
    assert got.columns == ["doc_id", "text", "a.b", "source", "SLOT", "n_cut"]
    got.write.parquet(str(tmp_path / "cut"))
    assert {r.doc_id: (r["a.b"], r.n_cut > 0) for r in got.collect()} == {1: ("q", False), 2: ("r", True)}
    mixed = mix(df.withColumns({"Position": F.lit(1), "BLOCK": F.lit(2)}))
    assert mixed.columns == ["doc_id", "text", "N_CUT", "a.b", "source", "source_pos", "block", "slot", "position"]
    mixed.write.parquet(str(tmp_path / "mixed"))
    assert sorted(r["a.b"] for r in mixed.collect()) == ["q", "r"]
