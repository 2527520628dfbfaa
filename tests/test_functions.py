"""Exact string semantics checked against Python's standard library."""

import fnmatch
import hashlib
import hmac
import os
import uuid

from pyspark.sql import functions as F

from quarry.functions import keys as K
from quarry.functions import paths as P
from quarry.operators import links, privacy, registry


def one_col(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_extension_matches_splitext(spark):
    paths = ["a.py", ".bashrc", "..a", "..a.b", "x.tar.gz", "a.b/c", "a.", "A/B.PY", "dir.d/.x.md", ".png",
             "Makefile", "a/b/c.D", "...", "a..", "x/.y.z", "noext/", "a b.c d"]
    got = one_col(spark, paths, P.extension)
    want = [os.path.splitext(p.rsplit("/", 1)[-1].lower())[1] for p in paths]
    assert got == want


def test_raw_extension(spark):
    assert one_col(spark, ["a.PY", "dir.d/file", "Makefile"], P.raw_extension) == ["PY", "d/file", ""]


def test_binary_suffix(spark):
    assert one_col(spark, [".png", "x.OGG", "a.pngx", "a/b.tar.gz"], P.is_binary) == [True, True, False, True]


def test_glob_matches_fnmatch(spark):
    pats = ["src/**/*", "*.md", "[!a]*.py", "x[", "*", "**/*", "a?c", "docs/*.txt", "[a-c]x", "foo[!]]",
            "*.tar.gz", "**.py", "t*/*/x", "[a-]q", "src/**", "*/de/*"]
    paths = ["src/a.py", "src/x/y.py", "src", "d/a.md", "b.py", "a.py", "x[", "abc", "docs/x/y.txt", "bx",
             "foo]", "x.tar.gz", "m/n.py", "tx/y/x", "-q", "aq", "src/", "a/de/b"]
    rows = [(p, s) for p in pats for s in paths]
    df = spark.createDataFrame(rows, "pat string, path string")
    got = {}
    for p in pats:
        for r in df.filter(F.col("pat") == p).select("path", P.glob_match(F.col("path"), p).alias("m")).collect():
            got[(p, r.path)] = r.m
    for p, s in rows:
        norm = P.normalise_glob(p)
        want = True if norm is None else fnmatch.fnmatch(s, norm)
        assert got[(p, s)] == want, (p, s)


def test_folder_scope(spark):
    df = spark.createDataFrame([("src/a",), ("src/a/b",), ("src/ab",)], "path string")
    from quarry.operators.paths import scope_to_folder
    assert [r.path for r in scope_to_folder(df, "src/a").collect()] == ["src/a", "src/a/b"]


def test_resolve_links(spark):
    rows = [("https://github.com/o/r.git", "github"), ("https://github.com/o/r/tree/main/src/a?x=1", "github"),
            ("https://gitlab.com/g/p/-/tree/main/a/b", "gitlab"), ("https://github.com/o/r/tree/main", "github"),
            ("https://bitbucket.org/w/r/src/dev/x/", "bitbucket"), ("https://gitlab.com/g/sub/p", "gitlab")]
    df = spark.createDataFrame(rows, "url string, provider string")
    out = [(r.repo_path, r.folder_path) for r in links.resolve_links(df, "url", "provider").collect()]
    assert out == [("o/r", ""), ("o/r", "src/a"), ("g/p", "a/b"), ("o/r", ""), ("w/r", "x"), ("g/sub/p", "")]


def test_norm_url_modes(spark):
    urls = ["https://github.com/A/Digit", "https://x.org/a/b.git/", "https://x.org/a/tig.git", "x//"]
    assert one_col(spark, urls, lambda c: K.norm_url(c, "suffix")) == [
        u.rstrip("/").lower()[:-4] if u.rstrip("/").lower().endswith(".git") else u.rstrip("/").lower() for u in urls]
    assert one_col(spark, urls, lambda c: K.norm_url(c, "charset")) == [u.rstrip("/").rstrip(".git").lower() for u in urls]


def test_uuid5_and_canonical_ids(spark):
    ids = ["user_2abc", "user_0", "", None, "00000000-0000-0000-0000-000000000000", "x" * 40,
           "{12345678-1234-5678-1234-567812345678}", "urn:uuid:12345678-1234-5678-1234-567812345678",
           "12345678123456781234567812345678", "ÄÖ-ünïcode"]
    got = one_col(spark, ids, K.canonical_user_id)

    def ref(s):
        if not s or s == "00000000-0000-0000-0000-000000000000":
            return "00000000-0000-0000-0000-000000000000"
        try:
            return str(uuid.UUID(s))
        except ValueError:
            return str(uuid.uuid5(uuid.NAMESPACE_OID, s))
    assert got == [ref(s) for s in ids]
    assert got[0] == "432a5050-a0f5-5998-b308-2fc7a00ab16d"


def test_hmac_sha256(spark):
    secrets = [b"s3cr3t", b"k" * 64, bytes(range(100)), "ключ".encode()]
    body = b'{"ref":"refs/heads/main","after":"abc"}'
    df = spark.createDataFrame([(s, body) for s in secrets], "secret binary, body binary")
    ipad, opad = K.hmac_pads(F.col("secret"))
    got = [r[0] for r in df.select(K.hmac_sha256_hex(ipad, opad, F.col("body"))).collect()]
    assert got == [hmac.new(s, body, hashlib.sha256).hexdigest() for s in secrets]


def test_utf8_replacement(spark):
    raw = [b"ok\xff", b"\xe2\x82", b"\xf0\x9f\x98x", b"caf\xe9", b"\xc0\xaf", "fine ✓".encode()]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "content binary")
    from quarry.operators.paths import decode_text
    got = [r.text for r in decode_text(df).collect()]
    assert got == [b.decode("utf-8", errors="replace") for b in raw]


def test_redact(spark):
    df = spark.createDataFrame([({"access_token": "abcdefghi", "refresh_token": "12345678", "client_id": "keep",
                                  "client_secret": None},), ({"scope": "x"},)],
                               "m map<string,string>")
    out = [r.m for r in privacy.redact_credentials(df, "m").collect()]
    assert out[0] == {"access_token": "abcd...fghi", "refresh_token": "***", "client_id": "keep", "client_secret": "***"}
    assert out[1] == {"scope": "x"}


def test_path_validation(spark):
    df = spark.createDataFrame([("a..b",), ("/a",), ("a" * 1000,), ("a" * 1001,), ("",), (" ok ",)], "path string")
    ok, bad = registry.validate_paths(df)
    assert sorted(r.path for r in ok.collect()) == sorted(["a" * 1000, "ok"])
    assert {r.path: r.reason for r in bad.collect()} == {
        "a..b": "path_traversal", "/a": "path_traversal", "a" * 1001: "path_too_long", "": "path_required"}


def test_sanitize_metadata_semantics():
    text = ('{"a": true, "b": 1.0, "c": 12, "d": null, "e": [1, "x", null, {"n": 1}, false], '
            '"f": {"g": 2.5, "h": [true]}, "' + "k" * 101 + '": "drop", "long": "' + "z" * 1005 + '"}')
    import json
    out = json.loads(privacy.sanitize_json_text(text))
    assert out == {"a": "True", "b": "1.0", "c": "12", "e": ["1", "x", "False"],
                   "f": {"g": "2.5", "h": ["True"]}, "long": "z" * 1000}
    assert privacy.sanitize_json_text("[1,2]") == "{}"
