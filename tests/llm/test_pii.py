import random
import re
import time
from hashlib import sha256

from featspark.llm.pii import find_pii, pii_digest

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def check(docs):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault(r["doc_id"], []).append(brute(r["text"]))
    got = pii_digest(docs).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        options = [s for s in want[r["doc_id"]] if sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest() == r["base_sha256"]]
        assert options, r
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in options[0]) for x in BASE]
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in options[0]).split(",")) - {""} <= set(r["spans"].split(","))


def test_tables(documents, awkward, no_docs):
    for docs in (documents, awkward, no_docs):
        check(docs)


def test_random_text(spark):
    rng = random.Random(1)
    bits = ["a@b.co", "@", ".", "-", "_", "%", "x", "1", "22", "255", "256", "1.2.3.4", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "+49 (30) 1234-567", "+1", " ", "é", "😀", "\n", "(", ")", "+", "0", "4000000000000002", "a@b@c.de", "1.2.3.4.5.6.7.8", "a@b.co_x@y.z"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_long_texts_take_linear_time(spark):
    rows = [(0, "a" * 300_000), (1, "1" * 300_000), (2, "a.b" * 100_000 + "@"), (3, "+1" + "(" * 300_000), (4, "a@b" + ".c" * 100_000),
            (5, "1." * 150_000), (6, "1 " * 150_000), (7, "x@y.zz " * 3000), (8, "AB12" * 50_000), (9, "me@y.zz " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii_digest(docs).collect()}
    assert time.perf_counter() - began < 60 and got[9]["n_email"] == 40_000
    assert got[9]["spans"].endswith(f"email:{8 * 39_999}:{8 * 39_999 + 7}")
    assert got[7]["n_email"] == 3000 and got[4]["n_email"] == 1
    assert got[5]["n_ip"] == 37500


def test_checksums_and_context_add_spans(spark):
    rows = [(0, "My IBAN is DE89 3704 0044 0532 0130 00."), (1, "DE89 3704 0044 0532 0130 01"), (2, "SSN 123-45-6789"), (3, "part 123-45-6789")]
    got = {r["doc_id"]: [(f["kind"], f["score"]) for f in r["findings"]] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("iban", 1.0) in got[0] and "iban" not in dict(got[1])
    assert got[2] == [("ssn", 0.8)] and got[3] == []


def test_no_python_in_plan(documents):
    plan = pii_digest(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def found(spark, *texts):
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[(f["kind"], texts[r["doc_id"]][f["start"]:f["end"]], f["score"]) for f in r["findings"] if f["kind"] in ("ssn", "iban")]
            for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_context_reaches_over_other_matches(spark):
    got = found(spark, "SSN 123-45-6789, 987-65-4321", "123-45-6789, 987-65 and 987-65-4321 ssn", "SSN 123-45-6789 " + "far " * 12 + "987-65-4321", "123-45-6789 987-65-4321 SSN")
    assert got[0] == [("ssn", "123-45-6789", 0.8), ("ssn", "987-65-4321", 0.8)]
    assert got[1] == [("ssn", "987-65-4321", 0.8)] and got[2] == [("ssn", "123-45-6789", 0.8)]
    assert len(got[3]) == 2


def test_iban_ends_where_its_country_says(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    got = found(spark, f"IBAN: {iban} BIC: COBADEFFXXX", f"IBAN {iban.replace(' ', '')} BIC COBADEFFXXX", f"{iban} 12345", f"AB12 {iban}", "IBAN GB82 WEST 1234 5698 7654 32 BIC X",
                "DE89 3704 0044 0532 0130 01 BIC")
    assert [[m for _, m, _ in g] for g in got] == [[iban], [iban.replace(" ", "")], [iban], [iban], ["GB82 WEST 1234 5698 7654 32"], []]
