"""What is blanked as a credential, and what stays. Keys are put together here so that none stands in the file."""

from pyspark.sql import functions as F

from millrace.functions import tokens

ALNUM = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R"
GOES = {
    "AK" + "IA" + "ABCDEFGHIJKLMNOP": "",
    "gh" + "p_" + ALNUM[:24]: "",
    "github" + "_pat_" + ALNUM[:22]: "",
    "gl" + "pat-" + ALNUM[:20]: "",
    "AI" + "za" + ALNUM: "",
    "s" + "k-" + ALNUM[:20]: "",
    "xo" + "xb-" + ALNUM[:12]: "",
    "s" + "k_live_" + ALNUM[:16]: "",
    "v" + "ck_" + ALNUM[:16]: "",
    "ey" + "Jhbg.ey" + "Jzdw.c2ln": "",
    "postgres://app:p4ss@db/x": "",
    "-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----\nkept": "\nkept",
    "-----BEGIN PRIVATE KEY-----\ncut off": "",
    "Authorization: Basic dXNlcjpwYXNz": "",
    '"authorization": "Token abc"': '""',
    "bearer abcdefgh.ijklmnop==": "",
    "DB_PASSWORD=hunter22 next": "DB_ next",
    'api_key => "two words here" next': " next",
    "'client-secret': 'x'": "'client-",
    "my password is now hunter2, ok": "my , ok",
    "The tokens were a1-b2-c3.": "The ",
}
STAYS = [
    "the token is missing", "a secretary: Jonathan", "the password is 42", "tokens: 7", "bearer of bad news", "a basic understanding",
    "authorization was refused", "https://example.org/a:b@c", "AKIA and ASIA", "sk-short", "the key is under the mat", "ghp_short", "",
]


def test_credentials_go_and_other_texts_stay(spark):
    texts = [*GOES, *STAYS]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r.r for r in frame.withColumn("r", tokens.redact(F.col("t"))).orderBy("i").collect()]
    left = [g if g is None else g.replace(tokens.PLACEHOLDER, "") for g in got]
    assert dict(zip(texts, left)) == {**GOES, **{t: t for t in STAYS}}
    assert all(tokens.PLACEHOLDER in g for g in got[: len(GOES)]) and got[-1] is None


def test_long_runs_end(spark):
    long = ["token" * 40_000, "a" * 300_000 + "://", "password is " + "x" * 300_000, "-----BEGIN PRIVATE KEY-----" + "k\n" * 100_000, "bearer " + "." * 300_000]
    frame = spark.createDataFrame([(t,) for t in long], "t string")
    kept = [r.n for r in frame.select(F.length(tokens.redact(F.col("t"))).alias("n")).collect()]
    assert kept == [200_000, 300_003, 300_012, len(tokens.PLACEHOLDER), len(tokens.PLACEHOLDER)]
