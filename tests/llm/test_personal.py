"""Personal data: base spans against Python's regexes, reliabilities against a plain expectation-maximisation."""

import collections
import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from linkweave.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = "call 212-555-3456 or write to john [at] mail [dot] com, ssn 219-09-9999, iban DE89 3704 0044 0532 0130 00 and 2001:0db8:85a3:0000:0000:8a2e:0370:7334"
ODD = [
    "a@b.com_x@y.com..a@b..c@d.e 1.2.3.4.5.6.7.8 1.1.1.256 001.2.3.0255 4111 1111-1111 1111 +1 (2 3.4-5678901 9 .@a.b %@-.-",
    "9" * 3000, "a" * 3000 + " 1-" * 3000, "x@" + ".a" * 900, "\U0001F600é a@b.co 東京 10.0.0.1\n+49 30 123456-78", MORE, "", None, "4" * 14, "0" * 19, "+1234567890", "+123456789",
    "version 10.2.3.4 of 4111111111111111 +1 212 555 3456 212-555-3456",
]


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [(kind, said) for kind, said in ((s.split(":")[0], s) for _, _, s in sorted(out))]


def test_base_spans(spark, small):
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = personal.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        said = ",".join(s for _, s in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (r.doc_id, said, r.spans)
        counts = collections.Counter(k for k, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PATTERNS)
        assert {s for _, s in want} <= set(r.spans.split(",")) and (r.n_added > 0 or r.spans == said)
    added = {r.doc_id: r.spans.split(",") for r in rows if r.n_added}
    here = [s.split(":") for s in added[-1 - ODD.index(MORE)]]
    assert {k: MORE[int(a) : int(b)] for k, a, b in here} == {
        "local_phone": "212-555-3456", "mailbox": "john [at] mail [dot] com", "national_id": "219-09-9999",
        "iban": "DE89 3704 0044 0532 0130 00", "ipv6": "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    }
    assert all(not any(s.split(":")[0] in ("local_phone",) and "phone" in v for s in v) for v in added.values())


def plain_rounds(rows):
    """Posteriors of (kind, votes, number) by expectation-maximisation in numpy."""
    kind, votes, n = np.array([k for k, _, _ in rows]), np.array([v for _, v, _ in rows]), np.array([c for _, _, c in rows], float)
    odds = votes.sum(axis=1).astype(float)
    for _ in range(personal.ROUNDS):
        p = 1 / (1 + np.exp(-odds))
        odds = np.zeros(len(n))
        for k in set(kind):
            odds[kind == k] = math.log(((n * p)[kind == k].sum() + 1) / ((n * (1 - p))[kind == k].sum() + 1))
        for j in range(votes.shape[1]):
            yes = {v: (n * p)[votes[:, j] == v].sum() + personal.PSEUDO[1][v + 1] for v in (-1, 0, 1)}
            no = {v: (n * (1 - p))[votes[:, j] == v].sum() + personal.PSEUDO[0][v + 1] for v in (-1, 0, 1)}
            odds += np.array([math.log(yes[v] / sum(yes.values()) / (no[v] / sum(no.values()))) for v in votes[:, j]])
    return 1 / (1 + np.exp(-odds))


def test_posteriors_and_classifier(spark):
    texts = [f"{a} {b} {c}" for a in ("call", "version", "", "ssn") for b in ("212-555-3456", "219-09-9999", "10.1.2.3", "me@web.de", "000-00-0000", "+49 30 12345678") for c in ("ext", "now", "/x")]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    seen = personal.labelled(docs)
    parameters = personal.reliabilities(seen)
    rows = seen.select("*", personal._posterior(parameters).alias("p")).collect()
    counted = collections.Counter((r.kind_no, tuple(r.votes)) for r in rows)
    patterns = [(k, v, n) for (k, v), n in counted.items()]
    want = {(k, v): p for (k, v, _), p in zip(patterns, plain_rounds(patterns))}
    assert all(abs(r.p - want[r.kind_no, tuple(r.votes)]) < 1e-3 for r in rows)
    # the classifier's weights from the same posteriors
    yes, no = collections.Counter(), collections.Counter()
    for r in rows:
        for f in r.features:
            yes[f] += r.p
            no[f] += 1 - r.p
    total = [sum(r.p for r in rows) + 1, sum(1 - r.p for r in rows) + 1]
    share = total[0] / sum(total)
    weights = {f: math.log((yes[f] + 4 * share) / (no[f] + 4 * (1 - share))) - math.log(share / (1 - share)) for f in yes}
    score = {
        (r.doc_id, r.start, r.kind_no): 1 / (1 + math.exp(-(parameters[len(personal.LABELERS), r.kind_no] + sum(weights[f] for f in r.features)))) for r in rows
    }
    got = {(r.doc_id, r.start, r.kind_no): r.score for r in personal.judged_spans(docs).collect()}
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 1e-6 for k in got)
    # a labeler that agrees with the others weighs more than one that is at odds with them
    edges, against = personal.LABELERS.index("edges"), personal.LABELERS.index("against")
    assert parameters[edges, 1] > parameters[edges, -1] and parameters[against, 0] > parameters[against, -1]


def test_odd_rows(spark, odd, nothing):
    docs = odd.withColumn("kind_no", F.lit("clash")).withColumn("hit", F.lit("clash")).withColumn("start", F.lit("clash")).withColumn("votes", F.lit("clash"))
    extra = docs.where("doc_id = 5").withColumn("text", F.lit("mail me@web.de"))
    rows = personal.scan(docs.unionByName(extra)).collect()
    assert len(rows) == docs.count() + extra.count()
    assert sorted(r.spans for r in rows if r.doc_id == 5) == ["", "", "", "email:5:14", "email:5:14", "email:5:14"]
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id != 5)
    assert personal.scan(nothing).collect() == []


def test_the_main_path_has_no_python_worker(spark, small):
    plan = personal.scan(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
