import zlib

import numpy as np
from emberline.llm import language, registry

DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, lang, "src", "s", "p") for i, x, lang in rows], DOCS)


def bundle(space, text):
    """One n-gram after the other, without counts or matrices."""
    codes, out = language.letters(text.encode()), np.zeros(space.dimensions, np.int64)
    for k in range(len(codes) - 2):
        one = np.ones(space.dimensions, np.int64)
        for j in range(3):
            one = one * np.roll(space.letter(int(codes[k + j])), 2 - j)
        out += one
    return out


def test_bundles_equal_one_by_one(monkeypatch):
    texts = ["Hello, wörld!", "", "123 ..", "a", "日本語のテキスト and Latin", "x" * 50, "été"] * 3
    want = None
    for piece in (1 << 20, 7):
        monkeypatch.setattr(language, "PIECE", piece)
        space = language.Space(64, most=8)
        got = space.bundles(((i, language.letters(x.encode())) for i, x in enumerate(texts)), len(texts))
        want = np.stack([bundle(space, x) for x in texts]) if want is None else want
        assert np.array_equal(got, want)


def test_many_letters_take_the_sorted_way():
    text = "".join(chr(0x4E00 + i * 37 % 9000) for i in range(400))
    space = language.Space(32)
    assert np.array_equal(space.bundles([(0, language.letters(text.encode()))], 1)[0], bundle(space, text))


def test_held_out_accuracy(spark):
    for sf, least in (("sf0.001", 0.98), ("sf0.01", 0.99)):
        path = f"/root/testdata/{sf}"
        truth = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
        got = registry.queries()["op12_language"](spark, path).collect()
        assert sorted(r.doc_id for r in got) == sorted(truth)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
        assert all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out]
        assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) >= least


def test_held_out_rows_teach_nothing(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2)
    learned = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learned[0], "the cat and the dog", "en"), (learned[1], "der hund und die katze", "de"), (held, "le chien et le chat", "fr"), (learned[2], None, "xx"), (learned[3], "12 34", "yy"), (learned[4], "sans nom", None)]
    names, matrix = language.fit(frame(spark, rows), 256)
    assert names == ["de", "en"] and matrix.shape == (2, 256)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, rows), (names, matrix)).collect()}
    assert got[learned[0]][0] == "en" and got[learned[0]][1] > 0.99
    assert got[learned[2]] == got[learned[3]] == ("und", 0.0)
    assert got[held][0] in names


def test_edges(spark):
    empty = frame(spark, [])
    model = language.fit(empty)
    assert model[0] == [] and language.identify(empty, model).count() == 0
    assert {tuple(r) for r in language.identify(frame(spark, [(1, "words", "en")]), model).select("doc_id", "lang_pred", "score").collect()} == {(1, "und", 0.0)}
    rows = [(1, "the one " * 5, "en")] * 3 + [(None, "der eine " * 40_000, "de"), (4, "퟿\u0000‍", "en"), (5, "É", "fr")]
    model = language.fit(frame(spark, rows), 128)
    out = language.identify(frame(spark, rows), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out.collect())[:1] == [(0, "de")]
    assert out.filter("doc_id = 1 AND lang_pred = 'en'").count() == 3
    assert len({r.score for r in out.filter("doc_id = 1").collect()}) == 1


def test_ties_go_to_the_first_language(spark):
    learned = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "same words here", lang) for i, lang in zip(learned, "bac", strict=False)]
    model = language.fit(frame(spark, rows), 128)
    assert model[0] == ["a", "b", "c"]
    assert {r.lang_pred for r in language.identify(frame(spark, rows), model).collect()} == {"a"}
