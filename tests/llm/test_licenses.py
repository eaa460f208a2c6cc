import random
import re

from quern.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(UPPER))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_by_brute_force(spark, docs, rows):
    more = ["CC BY cc by CC-BY-SA", "cc bye CC. BY", "All rights reserved. all Rights\nReserved", "GNU General Public\tLicense v3; Émile ÉMILE", "Kelvin K sign cc by", "ccby"]
    df = docs.union(spark.createDataFrame([(1000 + k, t, "en", "s", 1) for k, t in enumerate(more)], docs.schema))
    got = licenses.scan_licenses(df).collect()
    want = [(i, *base(t)) for i, t in [(x[0], x[1]) for x in rows] + [(1000 + k, t) for k, t in enumerate(more)]]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)


def test_templates_are_found_and_need_their_phrases():
    index = licenses.Index(1000, {"the": 900, "license": 20, "under": 700})
    scan = lambda t: index.scan(d := licenses.normal(t), d.split())
    for t in licenses.TEMPLATES:
        labels, support = scan(f"Some words before. {t.text.title()}, and after")
        assert t.label in labels and support == 1
    assert "mit" in scan("released under the well known mit license")[0]
    assert "mit" not in scan("released under the licence of mit")[0]
    assert "apache-2.0" not in scan("licensed under the apache tomcat version 2 0")[0]
    assert "cc-by-nc" in scan("Licensed under CC BY-NC 4.0.")[0] and scan("") == (set(), 0.0)
    assert "gpl" not in scan("the public license of the general")[0]


def test_a_file_with_every_notice_has_every_label():
    index = licenses.Index(1000, {"the": 900, "license": 20, "under": 700})
    d = licenses.normal("\n\n".join(f"Notice {k}. {t.text}." for k, t in enumerate(licenses.TEMPLATES)))
    assert index.scan(d, d.split())[0] == {t.label for t in licenses.TEMPLATES}


def scanned(index, words):
    """Labels and support by trying every template at every place where one of its rare words stands."""
    labels, best = set(), 0.0
    for t, ws in enumerate(index.words):
        rare = {w for w, held in index.postings.items() if any(k == t for k, _ in held)}
        for start in range(-len(ws), len(words)):
            if not any(w in rare and 0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(ws)):
                continue
            total = sum(index.idf[w] for w in ws)
            got = sum(index.idf[w] for p, w in enumerate(ws) if w in words[max(0, start + p - licenses.SHIFT) : max(0, start + p + licenses.SHIFT + 1)])
            near = b" " + b" ".join(words[max(0, start - licenses.SHIFT) : start + len(ws) + licenses.SHIFT]) + b" "
            if min(1, got / total) >= licenses.SUPPORT and all(f" {p} ".encode() in near for p in index.templates[t].phrases):
                labels.add(index.templates[t].label)
                best = max(best, min(1, got / total))
    return labels, best


def test_labels_and_scores_by_brute_force(spark):
    r = random.Random(4)
    texts = []
    for _ in range(40):
        words = []
        for t in r.sample(licenses.TEMPLATES, r.randint(0, 6)):
            words += [w for w in t.text.split() if r.random() > 0.08] + r.choices(["of", "license", "software", "stone", "copy"], k=r.randint(0, 9))
        texts.append(" ".join(w.title() if r.random() < 0.3 else w for w in words))
    texts += ["", None, " ".join(t.text for t in licenses.TEMPLATES)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = docs.selectExpr("*", "'x' as word", "1 as n", "'y' as labels", "2.0 as score")
    index = licenses.Index(*licenses.document_frequencies(docs))
    got = {x["doc_id"]: x for x in licenses.scan_licenses(wide).collect()}
    found = 0
    for i, t in enumerate(texts):
        labels, best = scanned(index, licenses.normal(t or "").split())
        base_labels = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base_labels
        assert abs(got[i]["score"] - max(best, 1.0 if base_labels else 0.0)) < 1e-9
        found += len(labels)
    assert found > 60


def test_frequencies_cover_all_rows(docs, rows):
    n, df = licenses.document_frequencies(docs)
    assert n == len(rows) and df["of"] == sum("of" in (t or "").translate(UPPER).replace(".", " ").split() for _, t, *_ in rows)


def test_empty(no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0
