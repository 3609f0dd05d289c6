"""Secrets in the plainest forms: unquoted assignments, query strings, short values, keys without a keyword."""

import hashlib

import pytest

from llm import secrets

HEX = hashlib.sha1(b"plain").hexdigest()
GHP = "ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC2"[:36]
SECRETS = [
    ("client_secret={}", HEX), ("export ACCESS_KEY={}\n", "AKIA" + HEX[:16].upper()), ("GITHUB_TOKEN={}", GHP), ("GET https://example.com/a?token={}&x=1", HEX[:32]),
    ("the key AKIA came up: {} and more", "AKIA" + HEX[4:20].upper()), ("we saw {} in the log", GHP), ("password=kestrel7", None), ('passwd: "violet anchors drift north"', None), ("DB_PASSWORD = Gl4cier!3x", None),
]
HARMLESS = [f"see commit {HEX}", f"md5: {HEX[:32]}", "password=your-pass-goes-here", "password: ${PG_PASS}", "token = fetch_token(user)", f"checksum={HEX}", "the secret: never give up"]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [form.format(value) for form, value in SECRETS] + HARMLESS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secrets.train(secrets.labelled_findings(spark))
    rows = secrets.scan(df, model).collect()
    for r in sorted(rows, key=lambda r: r.doc_id):
        print(r.is_secret, round(r.score, 2), texts[r.doc_id][r.start - 1 : r.start - 1 + r.n_chars], "<-", texts[r.doc_id])
    return texts, rows, {r.doc_id: r.text for r in secrets.redact(df, model).collect()}


@pytest.mark.parametrize("i", range(len(SECRETS)))
def test_secret_is_found_and_cut(scanned, i):
    texts, rows, cut = scanned
    value = SECRETS[i][1] or texts[i].split("=", 1)[-1].split(": ", 1)[-1].strip(' "')
    assert [texts[i][r.start - 1 : r.start - 1 + r.n_chars] for r in rows if r.doc_id == i and r.is_secret] == [value]
    assert cut[i] == texts[i].replace(value, secrets.MARK)


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless_stays(scanned, text):
    texts, rows, cut = scanned
    i = texts.index(text)
    assert not any(r.is_secret for r in rows if r.doc_id == i) and cut[i] == text
