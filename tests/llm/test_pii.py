import random
import re

from pyspark.sql import functions as F

from basketweave.llm import pii
from tests.llm.helpers import SCHEMA, make_docs, odd_docs


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def shape(s):
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", s)))


def changed(spark, *texts, key="k"):
    return [r["text"] for r in pii.pseudonymise(make_docs(spark, list(texts)), key).orderBy("doc_id").collect()]


def test_formats_stay_and_values_change(spark):
    texts = [
        "mail Jane.Doe99@example.org now", "card 4111 1111 1111 1111!", "call +1 (017) 555-7713.", "id 078-05-1120 ok",
        "born 1984-02-29,", "am 31.12.1999 und 05/13/2001", "card 4845168114407329###", "+14155552671 is it",
    ]
    for old, new in zip(texts, changed(spark, *texts)):
        assert old != new and shape(old) == shape(new), (old, new)
    ip = changed(spark, "host 10.20.30.40 up")[0]
    assert re.fullmatch(r"host \d+(\.\d+){3} up", ip) and all(int(x) < 256 for x in re.findall(r"\d+", ip))


def test_valid_values_stay_valid(spark):
    cards = changed(spark, "4111111111111111", "5500-0055-5555-5559", "340000000000009")
    assert all(luhn(re.sub(r"\D", "", c)) for c in cards)
    import datetime

    for d in changed(spark, *[f"20{y:02d}-02-28" for y in range(30)]):
        datetime.date.fromisoformat(d)


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "300.1.1.1", "2023-02-30", "000-12-3456", "version 4.0.1 of 12", "ab4111111111111111", "1" * 30, "0" * 16]
    assert changed(spark, *texts) == texts


def test_valid_values_next_to_other_numbers_change(spark):
    card, amex = "4111 1111 1111 1111", "3400 000000 00009"
    new_card, new_amex, new_phone, new_ssn, new_date = changed(spark, card, amex, "555-123-4567", "078-05-1120", "1984-02-29")
    forms = {card: new_card, "4111111111111111": new_card.replace(" ", ""), amex: new_amex, "555-123-4567": new_phone, "078-05-1120": new_ssn, "1984-02-29": new_date}
    texts = [
        "{0} 123", "4111111111111111 12/26", "12 {0}", "2024 {0}", "{0} 2024 {0}", "12-31 {0} 7 {0} 5", "555-123-4567 1234", "12345678 555-123-4567", "{0} 555-123-4567",
        "078-05-1120 {0}", "1 2 3 {0} 078-05-1120 99", "{0} 1984-02-29 5", "{1} 1234", "99 {1} 555-123-4567 7", "{0} 2nd", "1234 4111111111111111, 5", "5 {0} 6 {1} 7",
    ]
    texts = [t.format(card, amex) for t in texts]
    want = []
    for t in texts:
        for i, old in enumerate(forms):
            t = t.replace(old, f"<{i}>")
        for i, new in enumerate(forms.values()):
            t = t.replace(f"<{i}>", new)
        want.append(t)
    assert changed(spark, *texts) == want
    mail, dotted = changed(spark, f"{card} 55@example.org", f"{card} 555.123.4567")
    assert mail.startswith(new_card + " ") and mail.endswith("@example.org") and dotted.startswith(new_card + " ") and "123.4567" not in dotted
    row = pii.pseudonymise(make_docs(spark, [f"12 {card} 555-123-4567 9"]), "k").first()
    assert (row["n_card"], row["n_phone"]) == (1, 1)
    left = ["12345678-1234-1234-1234-123456789abc", " ".join("1234" for _ in range(3000)), "4111 1111 1111 1112 123 7"]
    assert changed(spark, *left) == left


def test_equal_values_stay_linked_and_keys_differ(spark):
    a, b = changed(spark, "x 4111111111111111 y 4111-1111-1111-1111", "z 4111111111111111")
    assert re.findall(r"\d{16}", a) == re.findall(r"\d{16}", b)
    assert re.sub("-", "", a.split()[3]) == a.split()[1]
    assert changed(spark, "4111111111111111", key="k2") != changed(spark, "4111111111111111")


def test_pairs_and_texts_are_permuted(spark):
    pairs = spark.range(35).select((F.col("id") / 7).cast("long").alias("a"), (F.col("id") % 7).alias("b"))
    got = {tuple(r[0]) for r in pairs.select(pii.permute_pair(F.col("a"), F.col("b"), 5, 7, "k")).collect()}
    assert got == {(a, b) for a in range(5) for b in range(7)}
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert len({r[0] for r in numbers.select(pii.permute_text(F.col("s"), "k")).collect()}) == 1000
    one = spark.range(10).select(pii.permute_text(F.col("id").cast("string"), "k").alias("s"))
    assert len({r[0] for r in one.collect()}) == 10


def test_odd_rows_and_counts(spark):
    docs = odd_docs(spark)
    got = pii.pseudonymise(docs, "k").collect()
    assert sorted(r["text"] for r in got) == sorted(r["text"] or "" for r in docs.collect())
    assert pii.pseudonymise(spark.createDataFrame([], SCHEMA), "k").count() == 0
    row = pii.pseudonymise(make_docs(spark, ["a@b.co 10.0.0.1 4111111111111111 4111111111111111"]), "k").first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 2, 0)


def test_no_python_in_the_plan(spark):
    plan = pii.pseudonymise(make_docs(spark, ["a"]), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_long_hosts_and_rows_do_not_break_the_matcher(spark):
    """Hosts of any length, long digits and long words end; what is no address stays."""
    texts = ["a@" + "a." * 3000 + "com", "a@" + "a." * 100_000 + "com", "a@" + "b" * 200_000 + ".com x", "7" * 3000, "a@b." * 20_000, "@" * 100_000]
    got = {r["doc_id"]: r for r in pii.pseudonymise(make_docs(spark, texts), "k").collect()}
    assert [got[k]["n_email"] for k in range(6)] == [0, 0, 1, 0, 0, 0]
    assert all(got[k]["text"] == t for k, t in enumerate(texts) if k != 2) and len(got[2]["text"]) == len(texts[2])


def test_tables_of_numbers_stay(spark):
    r = random.Random(8)
    texts = [" ".join(str(r.randint(0, 10 ** r.randint(1, 4) - 1)) for _ in range(100)) for _ in range(10)]
    texts.append("paid with 4111 1111 1111 1111 123 today, call 555-123-4567 555-765-4321 555-222-3333")
    got = {x["doc_id"]: x for x in pii.pseudonymise(make_docs(spark, texts), "k").collect()}
    changed = sum(got[k]["n_card"] + got[k]["n_phone"] for k in range(10))
    assert changed <= 1  # of 1,000 numbers: four groups of four that an issuer might have given
    assert (got[10]["n_card"], got[10]["n_phone"]) == (1, 3)
