"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.functions import cleaning, fingerprints as fpx, labels as lab, text as txt


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("value, kind, want", [
    ("3.0", "int", "3"), ("1.5", "float", "1.5"), ("2.0", "float", "2.0"), ("0.125", "float", "0.13"),
    ("12345678.9", "float", "12345678.9"), ("N", "str", "No"), ("Y", "str", "Yes"), ("x", "str", "x"), ("x", "date", None),
])
def test_label_text(spark, value, kind, want):
    assert one(spark, lab.label_text(s(value), s(kind))) == want


@pytest.mark.parametrize("label, want", [
    ("3", "-3"), ("1.5", "-1.5"), ("2.0", "-2"), ("-4", "4"), ("0", "0"), ("Yes", "No"), ("No", "Yes"), ("foo", None),
])
def test_negate(spark, label, want):
    assert one(spark, lab.negate_text(s(label))) == want


@pytest.mark.parametrize("text, want", [("-3.25 and 4", -3.25), ("1e5", 1.0), ("abc", None), ("5.", 5.0)])
def test_first_number(spark, text, want):
    assert one(spark, txt.first_number(s(text))) == want


def test_compact_number(spark):
    assert one(spark, txt.compact_number(s("- 1 2 . 5"))) == -12.5


@pytest.mark.parametrize("text, front, last", [("A b. C d. E?", "A b. C d", "E?"), ("One", "", "One"), ("v1.2 is. ", "v1.2 is", "")])
def test_sentences(spark, text, front, last):
    assert one(spark, txt.front_sentences(s(text))) == front
    assert one(spark, txt.last_sentence(s(text))) == last


def test_small_labels(spark):
    assert one(spark, lab.label_code(s("Y"))) == 1.0
    assert one(spark, lab.label_code(s("2.5"))) == 2.5
    assert one(spark, lab.sign_text(F.lit(-1))) == "No"
    assert one(spark, lab.sign_text(F.lit(0))) is None
    assert one(spark, lab.output_text(F.lit(1.0), s("cla"))) == "Yes"
    assert one(spark, lab.output_text(F.lit(2.5), s("reg"))) == "2.5"
    assert one(spark, lab.better(F.lit(1), F.lit(2), s("reg"))) is True
    assert one(spark, lab.better(F.lit(1), F.lit(2), s("cla"))) is False


def test_cleaning_order(spark):
    def reason(text, weight):
        best = cleaning.largest_component(s(text))
        return one(spark, cleaning.reject_reason(s(text), best["size"], F.lit(weight)))

    assert reason(None, 100) == -1
    assert reason("a b", 10) == -2
    assert reason("...", 100) == -2
    assert reason("a b c", 10) == -3
    assert reason("a b c", 1000) == -4
    assert reason("a b c", 100) == 0


def test_largest_component_takes_first_of_equals(spark):
    assert one(spark, cleaning.largest_component(s("a b. c d . e")))["component"] == "a b"


def test_render_and_response(spark):
    full = one(spark, catalog.render(s("Do {it}."), s("x{y}"), s(" done \n")))
    assert full.endswith("### Instruction:\nDo {it}.\n\n### Input:\nx{y}\n\n### Response:\n done \n")
    assert one(spark, txt.response(s(full), catalog.RESPONSE_MARKER)) == "done"
    assert "Input" not in one(spark, catalog.render(s("Do it."), s("")))
    assert one(spark, txt.response(s("nothing"), catalog.RESPONSE_MARKER)) == ""


def test_unknown_dataset():
    assert catalog.dataset_entry("tox21")[:2] == ("cla", 12)
    with pytest.raises(ValueError):
        catalog.dataset_entry("nope")


def bits(*numbers):
    return F.array(*[F.lit(n) for n in numbers]) if numbers else F.array().cast("array<int>")


@pytest.mark.parametrize("n_words, numbers", [(6, [0, 31, 32, 165]), (64, [0, 33, 255, 256, 1000, 2047]), (6, [])])
def test_words_round_trip(spark, n_words, numbers):
    words = fpx.bits_to_words(bits(*numbers), n_words)
    got = one(spark, words)
    assert len(got) == n_words
    assert [b for b in range(32 * n_words) if got[b // 32] >> (b % 32) & 1] == numbers
    packed = fpx.words_to_bytes(words)
    assert len(one(spark, packed)) == 4 * n_words
    assert one(spark, fpx.bytes_to_words(packed, n_words)) == got
    assert one(spark, fpx.popcount(words, n_words)) == len(numbers)


def test_distances(spark):
    a, b = fpx.bits_to_words(bits(2, 3)), fpx.bits_to_words(bits(1, 2))
    empty = fpx.bits_to_words(bits())
    assert one(spark, fpx.tanimoto_keys(a, b)) == pytest.approx(2 / 3)
    assert one(spark, fpx.tanimoto_keys(empty, empty)) is None


def test_conditional_distance(spark):
    ten = list(range(10))
    close, far = fpx.bits_to_words(bits(*ten)), fpx.bits_to_words(bits(*ten[:7]))
    near = fpx.bits_to_words(bits(*ten[:9]))
    x, y = fpx.bits_to_words(bits(1, 2), 64), fpx.bits_to_words(bits(2), 64)
    assert one(spark, fpx.tanimoto_conditional(F.concat(close, x), F.concat(far, y))) == pytest.approx(0.3)
    assert one(spark, fpx.tanimoto_conditional(F.concat(close, x), F.concat(near, y))) == pytest.approx(0.2 * 0.5)


def test_export_bytes(spark):
    assert one(spark, fpx.export_bytes(F.lit(None).cast("binary"))) == bytes(21)
    small = F.substring(fpx.words_to_bytes(fpx.bits_to_words(bits(0))), 1, 21)
    mixed = fpx.concat_bytes(maccs=small, ecfp4=fpx.words_to_bytes(fpx.bits_to_words(bits(5), 64)))
    assert len(one(spark, mixed)) == fpx.composite_bytes("maccs", "ecfp4") == 280
    assert one(spark, fpx.bytes_to_words(mixed, 70)) == one(spark, F.concat(
        fpx.bits_to_words(bits(0)), fpx.bits_to_words(bits(5), 64)))
    assert fpx.composite_bits("maccs") == 192
    assert fpx.table_name("ecfp4", "maccs") == "index-maccs-ecfp4"


def test_basic_features(spark):
    assert one(spark, fpx.basic_features(bits(4, 5, 6))) == [4, 5]
    assert one(spark, fpx.basic_features(bits(4, 5, 6), rich=True)) == [4, 5, 6]


def test_close_tokens(spark):
    def close(tokens, n):
        return one(spark, txt.close_tokens(F.array(*[F.lit(t) for t in tokens]), n, "</s>"))

    assert close(["a", "b"], 3) == ["a", "b", "</s>"]
    assert close(["a", "b"], 2) == ["a", "b"]
    assert close(["a", "</s>"], 5) == ["a", "</s>"]


def test_response_mask(spark):
    tokens = F.array(*[F.lit(t) for t in "a b c d".split()])
    assert one(spark, txt.response_mask(tokens, F.lit(2))) == ["-100", "-100", "c", "d"]
    assert one(spark, txt.response_mask(tokens, F.lit(5))) == ["-100"] * 5
    assert one(spark, txt.answer_tokens(tokens, F.lit(3))) == ["d"]


@pytest.mark.parametrize("value, want", [
    (12345678.0, "12345678.0"), (1e-4, "0.0001"), (-0.845, "-0.845"), (1e-7, "0.0000001"), (0.0049999999, "0.0049999999"),
    (123456789.125, "123456789.125"), (2.0, "2.0"), (0.0, "0.0"), (1.5e25, "15000000000000000000000000.0"), (float("nan"), "NaN")])
def test_number_text_is_lossless(spark, value, want):
    assert one(spark, lab.number_text(F.lit(value))) == want
    assert value != value or float(one(spark, lab.number_text(F.lit(value)))) == value


@pytest.mark.parametrize("value", ["1e19", "NaN", "inf", "-inf", "1e400", "", "9" * 60])
def test_no_label_ends_a_job(spark, value):
    for kind in ("int", "float", "str"):
        one(spark, lab.label_text(F.lit(value), F.lit(kind)))
    one(spark, lab.negate_text(F.lit(value)))


def test_tokens_of_any_script(spark):
    from shotweave.functions import fingerprints as fpx
    assert one(spark, fpx.tokens(F.lit("Éléphant, ПРИВЕТ 世界 a-1"))) == ["éléphant", "привет", "世界", "a", "1"]
    with pytest.raises(ValueError):
        fpx.feature_bits(F.array(F.lit("a")), 1 << 17)


ODD_TEXTS = [None, "", " \t", "...", "One one ONE", "İstanbul ΣΑΣ Σας straße STRASSE ß", "日本 語 x²y½", "a_b-c d e f\x00g", "é é",
             "𝔘𝔫𝔦 ①② Ⅷ", "word " * 30_000, "x" * 200_000, " ".join(f"t{i}" for i in range(5000)), "a" + "퟿" + "b"]


@pytest.mark.parametrize("layout", [(166, 6, 1), (2048, 64, 5), (7, 1, 2), (40, 2, 9)])
def test_encoder_equals_the_expression(spark, layout):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS * 3)], "i int, t string").repartition(3)
    words = rows.select("i", fpx.text_words(F.col("t"), *layout).alias("a"), fpx.encode_text(F.col("t"), *layout).alias("b")).collect()
    assert len(words) == 3 * len(ODD_TEXTS)
    assert all(r["a"] == r["b"] for r in words)
    assert {r["i"] % len(ODD_TEXTS) for r in words if r["b"] is None} == {0, 1, 2, 3}


def test_encoder_without_cache(monkeypatch):
    monkeypatch.setattr(fpx, "CACHED_TOKENS", 2)
    bits = fpx.TokenBits(166, 1)
    assert [bits[t] for t in "abcabc"] == [fpx.TokenBits(166, 1)[t] for t in "abcabc"]
    assert len(bits) == 2


def test_template_names(spark, tmp_path):
    assert catalog.load_template(spark, "") == catalog.TEMPLATES["alpaca"]
    with pytest.raises(ValueError):
        catalog.load_template(spark, "other")
    (tmp_path / "t.json").write_text('{"description": "x",\n "prompt_input": "{instruction}|{input}|",\n "prompt_no_input": "{instruction}|"}')
    own = catalog.load_template(spark, "t", str(tmp_path))
    assert own.response == catalog.RESPONSE_MARKER
    assert one(spark, catalog.render(s("a"), s("b"), s("c"), own)) == "a|b|c"
    assert one(spark, catalog.render(s("a"), s(""), template=own)) == "a|"
    (tmp_path / "bad.json").write_text('{"prompt_input": "x"}')
    with pytest.raises(ValueError):
        catalog.load_template(spark, "bad", str(tmp_path))


@pytest.mark.parametrize("separator", [".", "]", "^", "\\", "-", "||"])
def test_component_separators(spark, separator):
    part = cleaning.largest_component(s(separator.join(["x", "a b", "c"])), separator)
    assert one(spark, part.getField("component")) == "a b"
