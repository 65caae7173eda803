import hashlib
import random
import re
import time

import pytest

from basketweave.llm import secrets
from tests.llm.helpers import SCHEMA, make_docs, odd_docs, prose

BASE = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"),
]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]():
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


TEXTS = [
    "", None, 'password = "abcdefgh1"', "PassWord:short", "tOKEN=12345678 api_key : 'ABCDEFGH' APIKEY=zzzzzzzz", "ſecret=abcdefgh12 toKen=abcdefgh12", "AKIAABCDEFGHIJKL AKIA12 xAKIAAAAAAAAAAAAA",
    "é" * 10 + "token=" + "a" * 40, "f" * 31 + " " + "0" * 32, "deadbeef" * 8 + "g", "secret  =  x secret=yyyyyyyy", "password='password=abcdefgh'", "AKIAAKIA" * 3, "token = a\ntoken =\nabcdefgh1", prose(200),
]


def test_base_spans_match_the_patterns(spark):
    got = {r["doc_id"]: r for r in secrets.find_secrets(make_docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        kept = [s for s in got[i]["spans"].split(",") if s and not s.startswith("pair")]
        assert ",".join(kept) == want
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in kept) for k in ("assign", "access", "hex")]


def found(text):
    return [text[a:b] for a, b in secrets.assigned_literals(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('db_pass: "q9X!vT2#mm"', ["q9X!vT2#mm"]),
        ('k = "Zx81-qqPL-77"\nclient.secretKey = k', ["Zx81-qqPL-77"]),
        ("a = 'Zx81qq'\nb = 'PL77vv'\nAUTH_TOKEN = a + b", ["Zx81qq", "PL77vv"]),
        ('{"privateKey": "MIIEvQ1bADANB9"}', ["MIIEvQ1bADANB9"]),
        ('password = "changeme123"', []),
        ('password = "${DB_PASSWORD}"', []),
        ('colour = "q9X!vT2#mm"', []),
        ("the key: attention to detail", []),
        ("see http://secret.example.org/abc123XYZ", []),
    ],
)
def test_literals_reach_sensitive_names(text, want):
    assert found(text) == want


KEY = "q9X!vT2#mm"
FORMS = [
    'password: str = "%s"', 'const apiSecret: string = "%s"', 'cfg["db_password"] = "%s"', 'secret_key = """%s"""', "<password>%s</password>",
    'client.secretKey = k\nk = "%s"', 'privateKey string = "%s"', "mytool --db-pwd %s run", 'db_pwd = os.getenv("X", "%s")', 'db_pass: "%s"',
    "ENV DB_PASSWORD %s", "ARG DB_PASSWORD=%s", "export DB_PWD=%s", "DB_PWD=${DB_PWD:-%s}", 'define("DB_PASSWORD", "%s");', 'conn.setPassword("%s")',
    "- name: DB_PASSWORD\n  value: %s", '<add key="db_password" value="%s"/>', 'variable "db_password" {\n  type = string\n  default = "%s"\n}',
    'const pwd = process.env.PWD || "%s";', "db.password=%s", 'let password: Option<String> = "%s";', '{"privateKey": "%s"}', "my $pwd = '%s';",
    'String dbPassword = "%s";', "password: |\n  %s\n", "c = '%s'\nb = c\na = b\nlogin_password = a", "secret = a\na = b\nb = c\nc = '%s'", "it's the pwd: '%s', isn't it",
]


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_assignment(form):
    assert found(form.replace("%s", KEY)) == [KEY]


@pytest.mark.parametrize(
    "text, want",
    [
        ('auth_token = (\n  "Zx81qq"\n  "PL77vv"\n)', ["Zx81qq", "PL77vv"]),
        ("dsn = mysql://u:q9XvT2mm77@h/db", ["q9XvT2mm77"]),
        ("Authorization: Bearer q9XvT2mm77abc", ["q9XvT2mm77abc"]),
        ('passphrase = "correct horse battery staple"', ["correct horse battery staple"]),
        ('db_pwd = "sunshinebaby"', ["sunshinebaby"]),
        ('password = os.getenv("DB_PASSWORD_PROD")', []),
        ('label = t("password", "Enter your password")', []),
        ('password == "q9X!vT2#mm"', []),
        ('a = b + "x1"\nb = a + "y2"\npassword = a', []),
        ("the password: please ask at the desk", []),
    ],
)
def test_values_and_what_is_none(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text",
    [
        '"\\"' * 200_000, '"""\\' * 200_000, "password=" * 100_000, "password=f(" * 100_000, "a." * 500_000 + "password=", "<password>" * 100_000,
        "secret://" * 100_000, "password " + "w" * 1_000_000, "pwd[[" * 200_000, "key " + "1234 " * 200_000, "'\\'" * 200_000 + "password=1",
        "\n".join(f'password{i} = password{i - 1} + "x{i}Yq!"' for i in range(30_000)), "\n".join(f"pwd{i} = pwd{i - 1} + pwd{i - 1}" for i in range(30_000)),
    ],
    ids=lambda t: t[:12],
)
def test_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 30


def test_references_are_followed_to_their_end():
    """a value took in 64 literals and 4,096 characters of other names, in 8 passes."""
    assert found("password = a0\n" + "\n".join(f"a{i} = a{i + 1}" for i in range(50)) + f"\na50 = '{KEY}'") == [KEY]
    literals = [f"Zx{i}!" for i in range(300)] + ["".join(random.Random(i).choices("abcXYZ0189!#", k=90)) for i in range(100)]
    text = "\n".join(f'p{i} = "{x}"' for i, x in enumerate(literals))
    assert found(text + "\npassword = " + " + ".join(f"p{i}" for i in range(400))) == literals
    ring = "\n".join(f'p{i} = p{(i + 1) % 100} + "{x}"' for i, x in enumerate(literals[:100]))
    assert found(ring + "\npassword = p7") == literals[:100]


@pytest.mark.parametrize("seed", range(5))
def test_joined_values_score_as_spelt_out(seed):
    rng, spelt, lines = random.Random(seed), {}, []
    for i in range(200):
        alphabet = rng.choice(["abcXYZ019!#", "abc", "x", "$ab_", "a b", "<>{}()%s$", "a.b:c"])
        parts = [rng.choice([f"n{rng.randrange(i)}", None]) if i else None for _ in range(rng.randint(1, 3))]
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) if p is None else p for p in parts]
        if sum(len(spelt[x]) if p else 0 for p, x in zip(parts, texts)) > 20_000:
            texts, parts = ["abc"], [None]
        spelt[f"n{i}"] = "".join(spelt[x] if p else x for p, x in zip(parts, texts))
        lines.append(f"n{i} = " + " + ".join(x if p else f'"{x}"' for p, x in zip(parts, texts)))
    lines += [f"password{i} = n{i}" for i in range(200)]
    text = "\n".join(lines)
    read = secrets.assignments(text)
    names = {k: one.name for k, one in enumerate(read)}
    long = 0
    for k, _, value in secrets.Constants(text, read).resolved(set(names)):
        whole = spelt[names[k].replace("password", "n")]
        counted = value.counts is not None
        long += counted
        want = secrets.literal_score(whole, True, dict(secrets.Counter(whole)) if counted else None)
        assert secrets.literal_score(value.outline(text), True, value.counts) == pytest.approx(want), whole
    assert long > 20


def test_method_spans_come_on_top(spark):
    text = 'k = "Zx81-qqPL-77"\npassphrase = k; password=abcdefgh12'
    row = secrets.find_secrets(make_docs(spark, [text])).first()
    assert row["spans"] == f"pair:5:17,assign:{text.index('password')}:{len(text)}" and row["n_pair"] == 1


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert secrets.find_secrets(docs).count() == docs.count()
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []
