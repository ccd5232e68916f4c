"""Secret spans against a plain version with Python's regular expressions and dictionaries."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordrisk.llm.queries import ORACLES, QUERIES
from recordrisk.llm.secrets import ALPHABET, find_secrets, fit_secrets, secret_report, sum_before

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
KINDS = ["assign", "access", "hex", "random"]


def base(text):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def others(text, least):
    spans = base(text)
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
        if len(m[0]) >= least and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
            yield m.start(), 3, m.end(), m[0]


def model(texts):
    often = Counter(v for t in texts for *_, v in others(t, 8))
    words = {True: {v for t in texts for *_, v in base(t)}, False: {v for v, n in often.items() if n > 1}}
    pairs = {k: Counter((w[i - 1] if i else "", c) for w in some for i, c in enumerate(w)) for k, some in words.items()}
    total = {k: Counter() for k in pairs}
    for k, some in pairs.items():
        for (former, _), n in some.items():
            total[k][former] += n

    def ratio(word):
        out = 0
        for i, c in enumerate(word):
            former = word[i - 1] if i else ""
            seen = total[True][former]
            yes = 0.5 / len(ALPHABET) + 0.5 * pairs[True][former, c] / seen if seen else 1 / len(ALPHABET)
            no = (pairs[False][former, c] + 1) / (total[False][former] + len(ALPHABET))
            out += round(1e6 * (math.log(yes) - math.log(no)))
        return out

    return ratio


def plain(rows):
    rows = [(d, t or "") for d, t in rows]
    ratio, out = model([t for _, t in rows]), []
    name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
    for d, t in rows:
        mine = base(t)
        more = [s for s in others(t, 16) if ratio(s[3]) >= 750_000 * len(s[3])]
        out.append((d, *(sum(k == kind for _, k, *_ in mine) for kind in range(3)), hashlib.sha256(name(mine).encode()).hexdigest(), name(mine + more)))
    return out


def bag(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def hidden(rng, n):
    return "".join(rng.choice(ALPHABET[:62]) for _ in range(n))


@pytest.fixture(scope="module")
def tricky():
    rng = random.Random(9)
    low = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return [(100, f"Token: '{low(40)}' and API_KEY={hidden(rng, 9)} or apikey = short"), (101, f"secret: token: {hidden(rng, 20)}"),
            (102, f"😀é password==abcdefgh AKIA{hidden(rng, 20).upper()} AKIAAKIA AKIA1"), (103, low(31) + "g" + low(32) + " " + low(33) + "Z"),
            (104, f"a key {hidden(rng, 40)} in ordinary words, internationalization_of_things"), (104, f"a key {hidden(rng, 24)}"),
            (105, "token=a " * 3000 + f"token={hidden(rng, 12)}"), (106, f"passwd\x20\x20:\n{hidden(rng, 12)} paſſword=abcdefgh toKen=abcdefgh"),
            (107, "x" * 200_000), (108, low(100_000)), (109, "token=" + "=" * 9), (110, "4929348385146306 " * 3), (111, "AKIA" * 20 + "é" + "AKIA" * 3)]


def test_by_brute_force(spark, odd_rows, tricky):
    rows = odd_rows + tricky
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, base int").repartition(4)
    got = secret_report(docs, fit_secrets(docs))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert bag(got.collect()) == bag(plain(rows))


def test_sql_by_brute_force(odd_rows, tricky):
    """The SQL says what the plain version says where the method adds spans, too."""
    rng = random.Random(4)
    rows = odd_rows + tricky + [(200 + i, f"token={hidden(rng, 30)} and {hidden(rng, 30)}") for i in range(60)]
    parts = ["".join(rng.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(rng.randrange(4, 8))) for _ in range(200)]
    rows += [(300 + i // 2, "_".join(rng.choice(parts) for _ in range(600)).replace("_", " ", 300)) for i in range(2)]
    rows += [(400, " ".join(a + b for a in parts[:60] for b in parts[60:120])) for _ in range(2)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    want = plain(rows)
    assert any("random" in r[-1] for r in want)
    assert bag(con.sql(ORACLES["op13_secrets"]).fetchall()) == bag(want)


def test_hidden_keys_are_found_and_prose_is_not(spark, documents):
    rng = random.Random(3)
    rows = [(d, t) for d, t in documents] + [(-1 - i, f"the thing {hidden(rng, 32)} erth") for i in range(40)]
    rows += [(-100 - i, f"key token = {hidden(rng, 24)} end") for i in range(60)]  # these teach what a key looks like
    known = sorted({w for _, t in documents for w in re.findall("[a-z]{5,}", t)})
    names = [rng.choice(known) + rng.choice(["_", "", ".", "-"]) + rng.choice(known) for _ in range(20_000)]
    rows += [(10**6 + i, " ".join(names[i::50])) for i in range(50) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_secrets(docs, fit_secrets(docs)).where(F.exists("text_spans", lambda s: s["kind"] == "random")).select("doc_id").collect()
    ids = {r["doc_id"] for r in found}
    assert len([d for d in ids if -100 < d < 0]) >= 34 and not [d for d in ids if d >= 0 or d <= -100]


def test_query_by_brute_force(spark, data, documents):
    assert bag(QUERIES["op13_secrets"](spark, data).collect()) == bag(plain(documents))


def test_no_rows(spark, none, odd):
    assert secret_report(none, fit_secrets(none)).collect() == []
    assert secret_report(odd, fit_secrets(none)).count() == odd.count()  # models without samples tell no words apart


def test_no_python_workers(spark, data):
    plan = QUERIES["op13_secrets"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 97, 1000])
def test_sums_within_a_row(spark, n):
    got = spark.range(1).select(sum_before(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>") if n else F.array().cast("array<bigint>")).alias("s")).first()["s"]
    assert got == [i * (i + 1) // 2 for i in range(n)]
