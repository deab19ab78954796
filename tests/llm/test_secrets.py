import hashlib
import re

from harrow.llm import secretscan

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def line(spans):
    return ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_against_brute_force(odd_docs, no_docs, some_labels):
    got = secretscan.scan_documents(odd_docs, some_labels).collect()
    want = sorted((len([x for x in b if x[1] == 0]), len([x for x in b if x[1] == 1]), len([x for x in b if x[1] == 2]), hashlib.sha256(line(b).encode()).hexdigest()) for b in (brute(r.text) for r in odd_docs.collect()))
    assert sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert secretscan.scan_documents(no_docs, some_labels).count() == 0


def test_markov_spans_are_added_and_base_spans_stay(spark, sf_dir, odd_docs):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratios = secretscan.train(docs, labels)
    rows = secretscan.digest_columns(secretscan.scan(odd_docs.select("doc_id", "text"), ratios)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    seen = ""
    for r in rows:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert line(brute(texts[r.doc_id])) == ",".join(":".join(x) for x in spans if x[0] != "markov")
        seen += " ".join(texts[r.doc_id][int(x[1]) : int(x[2])] for x in spans if x[0] == "markov")
    assert "Zx9Qp2Lk8Vn4Rt7Wy3Bm6Hc1Jd5Gf0Sa" in seen
    assert "ordinary_identifier" not in seen


def test_all_native(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plan = secretscan.scan_documents(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_redaction(odd_docs, some_labels):
    ratios = secretscan.train(odd_docs, some_labels)
    out = secretscan.redact(secretscan.scan(odd_docs, ratios), odd_docs.columns)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    for r in out.collect():
        assert not brute(r.text) and (r.text is None or r.n_chars == len(r.text))
        assert "hunter2hunter2" not in (r.text or "")
