import hashlib

from eventloom.llm import op01_secrets as S


def test_find_drops_short_matches_without_rescanning_them():
    assert S.find_secrets("secret: token = abcdefgh", S.BASE) == []
    assert S.find_secrets('API_KEY: "abcdef"', S.BASE) == [("assign", 0, 16)]
    assert S.find_secrets("é AKIA" + "A" * 16, S.BASE) == [("access", 2, 22)]
    assert S.find_secrets("a" * 23 + "g" + "b" * 24, S.BASE) == [("hex", 24, 48)]


def test_ledger_scans_only_unseen_pairs(spark):
    docs = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("c", None), ("d", "")], "path string, text string")
    docs = S.with_blob_id(docs)
    ledger = S.scan_unseen(docs.select("blob_id", "text"))
    rows = ledger.collect()
    assert len(rows) == 2  # two distinct blobs: the secret, and empty (null and '')
    kept = spark.createDataFrame(rows, S.LEDGER)
    assert S.scan_unseen(docs.select("blob_id", "text"), kept).count() == 0
    assert S.scan_unseen(docs.select("blob_id", "text"), kept, rule_version="other").count() == 2
    found = {r.path: [f.kind for f in r.findings] for r in S.findings_by_path(docs, kept).collect()}
    assert found == {"a": ["assign"], "b": ["assign"], "c": [], "d": []}


def test_query_on_edge_rows(spark, tmp_path):
    rows = [(1, "x token = 'abcdefgh' y"), (1, "x token = 'abcdefgh' y"), (2, None), (None, ""), (3, "z" * 300_000 + "f" * 24)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS blob_id", "2 AS findings").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(S.op1_secret_scans(spark, str(tmp_path)).collect(), key=str)
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].spans == "assign:2:19" and by[1].n_assign == 1
    assert by[1].base_sha256 == hashlib.sha256(b"assign:2:19").hexdigest()
    assert by[2].spans == "" and by[None].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].spans == "hex:300000:300024"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert S.op1_secret_scans(spark, f"{tmp_path}/e").count() == 0


def test_redact_merges_overlaps_and_keeps_rows(spark):
    secret = "token=" + "a1" * 15  # an assignment and a hex run that overlap
    docs = spark.createDataFrame([(1, f"é {secret} b", 5), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.redact(docs).collect()}
    assert got == {1: ("é [REDACTED] b", 14), 2: (None, 0), 3: ("clean", 5)}


def test_redact_leaves_no_line_of_a_key(spark):
    body = "MIIEvQIBADANBg\nkqhkiG9w0BAQEF\n"
    begin, end = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"a {begin}{body}{end} b {begin}{body}{end} c"), (2, f"a {begin}{body}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in S.redact(docs).collect()} == {1: "a [REDACTED] b [REDACTED] c", 2: "a [REDACTED]"}


def test_runs_of_token_starts_take_linear_time():
    import time

    begun = time.time()
    assert S.find_secrets("eyJ" * 350_000, S.RULES) == []
    assert time.time() - begun < 1
    token = "eyJ" + "a" * 20 + "." + "b" * 20 + ".c"
    assert S.find_secrets(f"x{token} {token},{token}", S.RULES) == [("jwt", len(token) + 2, 2 * len(token) + 2), ("jwt", 2 * len(token) + 3, 3 * len(token) + 3)]


def test_a_stored_ledger_scans_what_is_new_only(spark, tmp_path):
    first = S.with_blob_id(spark.createDataFrame([("a", "token=abcdef"), ("b", None)], "path string, text string"))
    more = S.with_blob_id(spark.createDataFrame([("a", "token=abcdef"), ("c", "AKIA" + "A" * 16 + " token=abcdef")], "path string, text string"))
    ledger = S.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.rows() is None
    assert ledger.update(first).count() == 4  # two blobs, two rule sets
    assert ledger.update(first).count() == 4
    assert ledger.update(more).count() == 6
    again = {"base-1": S.BASE, "more-3": S.MORE}
    assert ledger.update(more, again).count() == 8  # the new version of one set, over the two blobs of this call
    doubled = ledger.rows().unionByName(ledger.rows())
    found = {r.path: [(f.kind, f.start) for f in r.findings] for r in S.findings_by_path(more, doubled, *again).collect()}
    assert found == {"a": [("assign", 0)], "c": [("access", 0), ("assign", 21)]}


def test_redact_keeps_columns_of_any_name(spark):
    names = ["blob_id", "findings", "row", "hit", "lacking", "seen", "rule_version", "kind", "a.b"]
    docs = spark.createDataFrame([(1, "token=abcdef", *(f"v{i}" for i in range(len(names))))], ["doc_id", "text", *names])
    (got,) = S.redact(docs).collect()
    assert got.asDict() == {"doc_id": 1, "text": "[REDACTED]", **{n: f"v{i}" for i, n in enumerate(names)}}
