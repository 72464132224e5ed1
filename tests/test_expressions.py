import hashlib
import math
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.functions import json as J
from shardloom.functions import text as X
from shardloom.functions import vectors as V
from shardloom.operators import chunk, prepare


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def each(rows, function, inputs, kind="string"):
    data = [(i, value) for i, value in enumerate(inputs)]
    df = rows(f"i int, c {kind}", data).select("i", function(F.col("c")).alias("out"))
    return [row["out"] for row in sorted(df.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "uid, expected",
    [
        ("12", "12"),
        ("007", "7"),
        ("0", "0"),
        (" 42 ", "42"),
        ("6BA7B811-9DAD-11D1-80B4-00C04FD430C8", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"),
        ("6ba7b8119dad11d180b400c04fd430c8", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"),
        ("urn:uuid:6ba7b811-9dad-11d1-80b4-00c04fd430c8", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"),
        ("abc", "68661508-f3c4-55b4-945d-ae2b4dfe5db4"),
        ("x_1", "c7fe5224-6b8a-5f17-9fb4-0128fc768b6b"),
        ("é", "10e1d6de-dc68-53f0-883a-30ec870dd739"),
        ("-5", str(uuid.uuid5(uuid.NAMESPACE_URL, "-5"))),
        (None, "99"),
        ("  ", "99"),
        ("nan", "99"),
        ("NaN", "99"),
    ],
)
def test_point_id(rows, uid, expected):
    df = rows("uid string, row_pos bigint", [(uid, 99)])
    assert values(prepare.assign_point_ids(df), "point_id") == [expected]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), min_size=1), min_size=20, max_size=40))
def test_uuid5_equals_the_standard_library(rows, names):
    assert each(rows, X.uuid5_url, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, name)) for name in names]


def test_vector_text(rows):
    texts = ["[0.1, 0.2]", "(1, 2)", "[1e3, -2]", "[]", None, " ", "abc", "[1, nan]", '[1,"a"]', "[1] foo", "5", '[1,"2"]',
             "[1, NaN]", "[1, null]", "[1, 2,]", "[5., .5, -.25]", "(1)", " [ 1 ] ", "[[1]]", "[1 2]"]
    assert each(rows, V.parse_vector, texts) == [
        [0.1, 0.2], [1.0, 2.0], [1000.0, -2.0], [], None, None, None, None, None, None, None, None,
        None, None, [1.0, 2.0], [5.0, 0.5, -0.25], None, [1.0], None, None]


def test_parse_vectors_drops_what_has_no_vector(rows):
    df = rows("i int, embedding string", [(1, "[1]"), (2, "[]"), (3, "x"), (4, None)])
    assert values(prepare.parse_vectors(df), "i") == [1]


def test_json_cells(rows):
    cells = ["[1,2]", '{"a":1}', '{""a"":1}', "{bad", "[1] foo", " ", " plain ", '{"a":1,"a":2}', None, "[1],[2]", "[1]],[[2]",
             ' {"a": "x"} ']
    found = each(rows, lambda c: F.to_json(J.json_cell(c)), cells)
    assert found == ["[1,2]", '{"a":1}', '{"a":1}', '"{bad"', '"[1] foo"', None, '" plain "', '"{\\"a\\":1,\\"a\\":2}"', None,
                     '"[1],[2]"', '"[1]],[[2]"', '{"a":"x"}']


def test_payload_object(rows):
    schema = "uid string, text string, embedding string, doc string, score double, `Unnamed: 3` string, _c7 string, blank string"
    df = rows(schema, [("u", "t", "[1]", '{"k": [1]}', math.nan, "j", "j", "  ")])
    out = prepare.build_payload(df, drop=("embedding", "text"), stamp={"tenant_name": "T"})
    assert values(out, F.to_json("payload")) == [
        '{"blank":null,"doc":{"k":[1]},"score":null,"tenant_name":"T","uid":"u"}']


def test_text_fallback(rows):
    data = [
        (1, " ", '{"text":"t"}', "t"), (2, None, '{""text"":""t""}', "t"), (3, "", '{"text":""}', None), (4, "", "{bad", None),
        (5, "", "[1]", None), (6, "own", '{"text":"t"}', "own"), (7, "", '{"text": 5}', None), (8, "", None, None),
    ]
    df = prepare.fill_text_from_doc(rows("i int, text string, doc string, expected string", data))
    for row in df.collect():
        assert row["text"] == row["expected"], row


def test_text_fallback_needs_both_columns(rows):
    df = rows("text string", [(" ",)])
    assert values(prepare.fill_text_from_doc(df), "text") == [" "]


def test_clean_markdown(rows):
    texts = ["a ![x](data:image/png;base64,AAA) b", '<img src="a">t', "![a](b(c)d)", "![a\nb](c)", "![a\rb](c)", None]
    assert each(rows, X.clean_markdown, texts) == ["a  b", "t", "d)", "![a\nb](c)", "", ""]


def test_blank_and_trim_follow_unicode(rows):
    texts = ["  ", "\x1c\x85", "", None, "　x ", "​"]
    assert each(rows, X.is_blank, texts) == [True, True, True, True, False, False]
    assert each(rows, X.trim_ws, texts)[4] == "x"
    for char in map(chr, range(0x3001)):
        assert (char in X.WHITESPACE) == (char.strip() == ""), hex(ord(char))


def test_embeddable_text(rows):
    assert each(rows, X.embeddable_text, [None, " ", "nan", " NaN ", "none", "<na>", " x "]) == [
        None, None, None, None, "none", "<na>", "x"]


def test_prefix(rows):
    assert each(rows, lambda c: X.prefix_text(c, "passage"), ["t", "Query: t", "passage: t"]) == [
        "passage: t", "Query: t", "passage: t"]
    assert each(rows, lambda c: X.prefix_text(c, ""), ["t"]) == ["t"]
    with pytest.raises(ValueError):
        X.prefix_text(F.col("c"), "other")


def test_token_count(rows):
    assert each(rows, X.token_count, ["a b\n c", "", None, "  x "]) == [3, 0, 0, 1]


def test_sanitize_numbers(rows):
    bad = [math.nan, math.inf, -math.inf, 1.5]
    df = rows("a double, b array<double>, c map<string,double>, d struct<x:double,y:string>, e int",
              [(math.nan, bad, {"k": math.inf}, (math.nan, "s"), 1), (None, None, None, None, None)])
    first, second = prepare.sanitize_numbers(df).collect()
    assert first["a"] is None and first["b"] == [None, None, None, 1.5]
    assert first["c"] == {"k": None} and tuple(first["d"]) == (None, "s") and first["e"] == 1
    assert list(second) == [None] * 5


def test_normalize(rows):
    out = each(rows, V.normalize, [[3.0, 4.0], [0.0, 0.0], [], None], "array<double>")
    assert out == [[0.6, 0.8], None, None, None]


def test_hash_embed_is_a_unit_vector_and_ignores_case_and_spacing(rows):
    a, b, c, none = each(rows, lambda c: V.hash_embed(c, 16), ["Alpha beta", " alpha\n BETA ", "gamma", " "])
    assert a == b and a != c and none is None
    assert math.isclose(sum(x * x for x in a), 1.0)


@pytest.mark.parametrize("dim", [1, 3, 32, 1000])
def test_hash_embed_equals_a_count_by_bucket(rows, dim):
    texts = ["a", "One two one THREE", " ".join(f"w{i % 7} v{i}" for i in range(300))]
    for text, found in rows("t string", [(t,) for t in texts]).select("t", V.hash_embed(F.col("t"), dim).alias("v")).collect():
        want = [0.0] * dim
        for word in text.lower().split():
            digest = hashlib.md5(word.encode()).hexdigest()
            want[int(digest[:8], 16) % dim] += 1 if digest[8] < "8" else -1
        norm = math.sqrt(sum(x * x for x in want))
        assert found == (pytest.approx([x / norm for x in want]) if norm else None)


def test_words_are_parted_by_unicode_white_space(rows):
    df = rows("t string", [("a\u00a0b\u3000c",), (" \u2003 ",)])
    assert [r[0] for r in df.select(X.token_count(F.col("t"))).collect()] == [3, 0]


@pytest.mark.parametrize("least", [0, 100])
def test_markdown_sections_are_packed(rows, least):
    text = "\n".join(f"## h{i}\n" + " ".join(f"w{i}_{j}" for j in range(58)) for i in range(20))
    out = chunk.chunk_markdown(rows("uid string, text string", [("d", text)]), min_words=least).orderBy("chunk_index").collect()
    assert len(out) == 4 and all(len(r["text"].split()) <= 400 for r in out)
    assert out[0]["text"].startswith("## h0\nw0_0") and "\n## h1\n" in out[0]["text"]
    # Six sections of 60 words fit; the last one of them opens the next window.
    assert [r["text"].split()[1] for r in out] == ["h0", "h5", "h10", "h15"]
    assert [r["text"].split()[-1] for r in out] == ["w5_57", "w10_57", "w15_57", "w19_57"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["# ", "## x", "a", "bb\tc", "d  e", "", "f\u00a0g"]), max_size=40), st.integers(1, 9))
def test_no_word_is_lost_without_a_minimum(rows, lines, size):
    text = "\n".join(lines)
    out = chunk.chunk_markdown(rows("uid string, text string", [("d", text)]), size=size, overlap=0, min_words=0).orderBy("chunk_index").collect()
    assert " ".join(r["text"] for r in out).split() == text.split()


def test_words_end_at_every_white_space_and_nowhere_else(rows):
    others = "\x00\x08\x0e\x1b!\x84\x86\x9f\xa1ᙿᚁ῿​‧‪‮‰⁞⁠⿿、﻿&[]-"
    found = each(rows, lambda c: F.size(X.words(c)), [f"a{c}b" for c in X.WHITESPACE + others])
    assert found == [2] * len(X.WHITESPACE) + [1] * len(others)


def test_a_character_within_words_is_not_compared_with_each_white_space():
    assert "&&" in X.WHITESPACE_RUN  # members beyond Latin-1 lie behind one test of their range
