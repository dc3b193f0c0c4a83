"""Further forms of personal data, findings without a bound on their length, and a key that no plan shows."""

import ipaddress
import re

from pyspark.sql import functions as F

from quern.llm import pii


def found(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]


def test_further_forms(spark):
    text = "ssn 123 45 6789; tel 0170 1234567; host 2001:db8::ff00:42:8329, 2001:0DB8:0:0:0:ff00:0042:8329; Amex 3782 822463 10005; phone: 5551234567; b@bücher.de; 12-31-1999, Jan 5, 1987, 3rd March 2004, 1987-01-05"
    row = found(spark, [text])[0]
    got = {x["value"]: (x["kind"], x["pseudonym"]) for x in row["pii"]}
    kinds = {v: k for v, (k, _) in got.items()}
    assert kinds == {
        "123 45 6789": "ssn", "0170 1234567": "phone", "2001:db8::ff00:42:8329": "ipv6", "2001:0DB8:0:0:0:ff00:0042:8329": "ipv6", "3782 822463 10005": "card",
        "5551234567": "phone", "b@bücher.de": "email", "12-31-1999": "date", "Jan 5, 1987": "date", "3rd March 2004": "date", "1987-01-05": "date",
    }
    new = {v: p for v, (_, p) in got.items()}
    assert new["2001:db8::ff00:42:8329"] == new["2001:0DB8:0:0:0:ff00:0042:8329"] and ipaddress.IPv6Address(new["2001:db8::ff00:42:8329"])
    assert re.fullmatch(r"\d{3} \d{2} \d{4}", new["123 45 6789"]) and re.fullmatch(r"0\d{3} \d{7}", new["0170 1234567"])
    assert re.fullmatch(r"3\d{3} \d{6} \d{5}", new["3782 822463 10005"]) and re.fullmatch(r"[2-9]\d{9}", new["5551234567"])
    assert re.fullmatch(r"\d\d-\d\d-\d{4}", new["12-31-1999"])
    assert re.fullmatch(r"[A-Z][a-z]{2} \d{1,2}, \d{4}", new["Jan 5, 1987"]) and re.fullmatch(r"\d{1,2}(st|nd|rd|th) [A-Z][a-z]+ \d{4}", new["3rd March 2004"])
    # One day in two spellings stays one day.
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    month, day, year = re.fullmatch(r"(\w+) (\d+), (\d+)", new["Jan 5, 1987"]).groups()
    assert new["1987-01-05"] == f"{year}-{months.index(month) + 1:02}-{int(day):02}"
    again = found(spark, [row["text"]])[0]
    assert sorted(x["kind"] for x in again["pii"]) == sorted(kinds.values())


def test_what_only_looks_alike_stays(spark):
    texts = ["x[100::2], std::map, fe::ed, 12:30:45, a 5551234567 b, 1700000000", "In May 2020 we may 5 times; Feb 30, 1999; 13-13-1999", "10 123 45 6789 11 rows, 12 0170 1234567 3", "monkey = banana; see 2001:db8:1:2:3 and 2001:1:2:3:4:5:6:7::8"]
    assert [r["pii"] for r in found(spark, texts)] == [[]] * 4 and [r["text"] for r in found(spark, texts)] == texts


def test_findings_of_any_length(spark):
    """Secrets, names and domains beyond all usual lengths go whole; repeated beginnings of findings are none."""
    long = "aB3" * 3_000
    jwt = f"eyJ{'a1B2' * 9}.eyJ{'c3D4' * 200}.{'e5F6' * 20}"
    texts = [f"token={long} end", f"sk_live_{long} end", f'key="{long}" end', f"mail {'n' * 300}@{'d1.' * 500}org end", f"bearer {jwt} end"]
    rows = found(spark, texts)
    assert [len(r["pii"]) for r in rows] == [1] * 5
    for r, t in zip(rows, texts, strict=True):
        assert len(r["text"]) == len(t) and r["text"].endswith(" end") and r["pii"][0]["value"] not in r["text"]
    assert rows[0]["pii"][0]["value"] == long and rows[4]["pii"][0]["value"] == jwt
    n = 40_000
    hostile = ["a" * n, "a." * n + "@", "eyJ" * n, "key=" * n, "2001:" * n, "a@b" + ".c" * (n // 10), "xoxa-" * (n // 10), "Jan 5 " * n]
    assert [len(r["pii"]) for r in found(spark, hostile)] == [0, 0, 0, 0, 0, 1, 1, 0]


def test_no_plan_shows_the_key(spark):
    done = pii.pseudonymise(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"), "very-secret-key")
    done.collect()
    plans = done._jdf.queryExecution()
    assert "very-secret-key" not in plans.toString() + plans.explainString(plans.executedPlan().getClass() and spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    alone = spark.createDataFrame([("a@b.cd",)], "v string").select(pii.pseudonym(F.col("v"), F.lit("email"), "very-secret-key").alias("p")).head()["p"]
    assert done.head()["pii"][0]["pseudonym"] == alone


def test_looks_at_neighbours_change_nothing(spark, small):
    """The gates before all kinds find what the kinds find alone, and a text that has a finding has a hint."""
    names = r"(?<=\b(?i:tel|phone|telephone|mobile|cell|fax|call|whatsapp)[.:]? {0,2})(?:0\d{9,11}|[2-9]\d{9})(?!\w|[-.]\d)"
    texts = ["tel0170123456789 Tel.: 5551234567, fax  5551234567x", 'KEY="abcdefghijklmnop" my_token= x9_-/+y8z api-key:_a1b2c3d4', "née@x.de _a@b.cd ßa@b.cd +49 170 1234567 (030) 1234 5678", "x3rd March 2004 May 5, 1987May 6, 1988"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").union(spark.read.parquet(f"{small}/documents.parquet").select("text"))
    plain = "|".join(f"(?:{p})" for p in [*pii.KINDS.values(), names])
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    got = rows.select(every(pii.ANY).alias("a"), every(plain).alias("b"), F.col("text").rlike(pii.HINT).alias("hint")).collect()
    assert [r for r in got if r["a"] != r["b"] or r["a"] and not r["hint"]] == []
    assert sum(len(r["a"]) for r in got[:4]) > 5
