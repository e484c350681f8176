import hashlib
import hmac
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave import schemas
from linkweave.constants import ID_CHARSET, WHITE_SPACE
from linkweave.functions import ids, text, tokens
from linkweave.functions.json import decode_array_body, decode_body, decode_line, encode_event

KEY = "bench-secret-key-32bytes-long!!"


def expected_id(key, attempt, charset=ID_CHARSET, length=8):
    number = int(hashlib.sha256(f"{key}:{attempt}".encode()).hexdigest()[:15], 16)
    return "".join(charset[number // len(charset) ** i % len(charset)] for i in range(length))


def test_short_id_is_a_function_of_key_and_attempt(column):
    urls = [f"https://example.org/{i}" for i in range(200)]
    for attempt in (0, 4):
        got = column(lambda c: ids.short_id(c, attempt), urls)
        assert got == [expected_id(u, attempt) for u in urls]
        assert all(re.fullmatch("[a-zA-Z0-9]{8}", g) for g in got) and len(set(got)) == 200
    assert column(lambda c: ids.short_id(c, 0, "abc", 2), urls) == [expected_id(u, 0, "abc", 2) for u in urls]


def test_random_ids(column):
    got = column(lambda c: F.concat_ws(" ", ids.random_short_id(), ids.link_uuid(), ids.new_user_id()), ["a"] * 20)
    assert len(set(got)) == 20
    shape = "[a-zA-Z0-9]{8} [0-9a-f-]{36} [0-9a-f]{32}"
    assert all(re.fullmatch(shape, g) for g in got)


def test_sign_and_verify(column):
    users = ["u1", "имя", "", "x" * 300]
    for key in (KEY, "k", "long" * 40):
        signed = column(lambda c: tokens.sign_token(c, key), users)
        assert signed == [u + "." + hmac.new(key.encode(), u.encode(), hashlib.sha256).hexdigest() for u in users]
        checked = column(lambda c: tokens.verify_token(c, key), signed)
        assert [tuple(c) for c in checked] == [(u, u != "") for u in users]


def test_tampered_tokens(column):
    good = column(lambda c: tokens.sign_token(c, KEY), ["u1"])[0]
    flipped = good[:-1] + ("0" if good[-1] != "0" else "1")
    bad = [None, "", ".", "u1", "u1.", "." + good, good.upper(), flipped, good + "0", good[:-1], "u2" + good[2:], "a." + good]
    assert all(tuple(c) == ("", False) for c in column(lambda c: tokens.verify_token(c, KEY), bad))


def test_authenticate(column):
    good = column(lambda c: tokens.sign_token(c, KEY), ["u1"])[0]
    seen = column(lambda c: tokens.authenticate(c, KEY, F.lit("fresh")), [good, None, "u1.bad"])
    assert [(s.user_id, s.valid, s.reissued) for s in seen] == [("u1", True, False), ("fresh", True, True), ("fresh", True, True)]
    assert seen[0].token == good
    assert tuple(column(lambda c: tokens.verify_token(c, KEY), [seen[1].token])[0]) == ("fresh", True)


def test_new_users_get_a_token_of_their_own(spark):
    rows = spark.range(20).select("id", tokens.derived_user_id(F.col("id"), KEY).alias("derived"), ids.new_user_id().alias("random"))
    for source in ("derived", "random"):
        seen = rows.select(tokens.authenticate(F.lit(None).cast("string"), KEY, F.col(source)).alias("a")).select("a.*")
        checked = seen.select("user_id", tokens.verify_token(F.col("token"), KEY).alias("t")).collect()
        assert all(r.t.valid and r.t.user_id == r.user_id and re.fullmatch("[0-9a-f]{32}", r.user_id) for r in checked)
        assert len({r.user_id for r in checked}) == 20


def test_unicode_trim(column):
    inputs = ["", "   \n\t   ", WHITE_SPACE, f"{WHITE_SPACE}a b{WHITE_SPACE}", "​a", "\x1ca"]
    assert column(text.unicode_trim, inputs) == ["", "", "", "a b", "​a", "\x1ca"]
    assert len(WHITE_SPACE) == 25
    assert column(text.is_blank, [None, " ", "a"]) == [True, True, False]


def test_join_path(column):
    for base in ("http://localhost:8080", "http://localhost:8080/"):
        assert column(lambda c: text.join_path(base, c), ["abc"]) == ["http://localhost:8080/abc"]


def test_clean_delete_id(column):
    cases = {
        "abc": "abc",
        "": "",
        "http://h/abc": "abc",
        "https://other.example/abc?x=1#f": "abc",
        "http://h/a%20b": "a b",
        "http://h/a+b": "a+b",
        "http://h/a b": "a b",
        "http://h//a": "/a",
        "http://h/a/b": "a/b",
        "http://u:p@h:80/x": "x",
        "http://[::1]:80/x": "x",
        "HTTP://h/abc": "HTTP://h/abc",
        "http://h": None,
        "http://h/": None,
        "http://h?x=/a": None,
        "http://h/%zz": None,
        "http://h h/a": None,
        "http://h:8x/a": None,
        "http://h/a\u0001": None,
        "http://h/a#%zz": None,
        "http://h/a#%41": "a",
        "http://h/a?%zz": "a",
        "ftp://h/a": "ftp://h/a",
        "http://h/" + "%41" * 20000 + "?" + "q" * 20000 + "#" + "%41" * 20000: "A" * 20000,
    }
    assert column(text.clean_delete_id, list(cases)) == list(cases.values())


def test_mask_password(column):
    cases = {
        "postgres://user:pw@db:5432/app": "postgres://user:***@db:5432/app",
        "postgres://user@db/app": "postgres://user:***@db/app",
        "postgres://u:p:q@db/app?x=a@b": "postgres://u:***@db/app?x=a@b",
        "postgres://db/app": "postgres://db/app",
        "host=db user=u": "host=db user=u",
        ":bad": "***",
        "postgres://u:p%zz@db/app": "***",
        "postgres://u:secret@db:54x2/app": "***",
        "postgres://u:secret\u0007@db/app": "***",
    }
    assert column(text.mask_password, list(cases)) == list(cases.values())


def test_small_helpers(column):
    assert column(text.deleted_flag, [True, False, None], "boolean") == [True, False, False]
    types = ["application/json", "text/html; charset=utf-8", "text/plain", "", None]
    assert column(text.compressible, types) == [True, True, False, False, False]


def test_decode_line(column):
    whole = '{"uuid":"1","short_url":"a","original_url":"o","user_id":"u","is_deleted":true}'
    zero = ("", "", "", "", False)
    cases = {
        whole: ("1", "a", "o", "u", True),
        whole + " x": None,
        whole + "," + whole: None,
        whole[:-1]: None,
        "": None,
        "5": None,
        "[]": None,
        "null": zero,
        "{}": zero,
        '{"short_url":null,"other":[1]}': zero,
        '{"short_url":5}': None,
        '{"is_deleted":"no"}': None,
        '{"short_url":"12.5"}': ("", "12.5", "", "", False),
        '{"short_url":"a","short_url":"b"}': ("", "b", "", "", False),
        '{"SHORT_URL":"a","Is_Deleted":true}': ("", "a", "", "", True),
    }
    got = column(lambda c: decode_line(c, schemas.LINK_LINE), list(cases))
    assert [g and tuple(g) for g in got] == list(cases.values())


def test_decode_bodies(column):
    urls = ['{"url":"https://example.org/"}', '{"url":"a"} tail', "null", '{"url":1}', "", "[]", '{"url":"  "}']
    got = column(lambda c: decode_body(c, schemas.URL_BODY), urls)
    assert [g and g.url for g in got] == ["https://example.org/", "a", "", None, None, None, "  "]
    arrays = ['["a","b"]', '["a",null] tail', "[]", "null", "{}", '["a",5]', '["a"']
    assert column(lambda c: decode_array_body(c, T.StringType()), arrays) == [["a", "b"], ["a", ""], [], [], None, None, None]
    items = ['[{"correlation_id":"1","original_url":"o"},{}]', '[{"original_url":5}]', "[1]", "null"]
    got = column(lambda c: decode_array_body(c, schemas.BATCH_ITEM), items)
    assert [g and [tuple(i) for i in g] for g in got] == [[("1", "o"), ("", "")], None, None, []]


def test_encode_event(column):
    lines = column(lambda c: encode_event(F.lit(42), F.lit("follow"), c, F.lit("https://b.example/?a=1&b=2")), ["", None, "u1"])
    bare = '{"ts":42,"action":"follow","url":"https://b.example/?a=1&b=2"}'
    assert lines == [bare, bare, bare.replace('"url"', '"user_id":"u1","url"')]
