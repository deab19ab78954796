import math
import zlib

from harrow.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels)
    assert rows.count() == docs.count()
    held = rows.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.collect())


def test_no_input_but_text(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    a = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score_documents(docs.drop("lang", "source"), labels).collect()}
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    c = {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert a == b == c


def test_odd_rows(spark, odd_docs, no_docs, some_labels):
    rows = quality.score_documents(odd_docs, some_labels)
    assert rows.count() == odd_docs.count()
    assert rows.where("score is null or predicted is null").count() == 0
    assert [r.held_out for r in rows.where("doc_id is null").collect()] == [None]
    assert quality.score_documents(no_docs, some_labels).count() == 0
    nothing = quality.score_documents(odd_docs, some_labels.where("false"))
    assert {r.score for r in nothing.collect()} == {0.5}
    kept = quality.filter_documents(odd_docs, some_labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


def test_temperature_and_both_labels_needed():
    model = quality.fit(["good text here"] * 5, [1] * 5)
    assert model.probability(quality.pooled("x", quality.Units(), model.vectors)[None])[0] > 0.9


def slow_score(model, text):
    """The score of one text word by word, without arrays of counts."""
    words = (text or "").encode().split()
    parts = [u for w in words for u in (w, quality.word_form(w))]
    parts += [u for a, b in zip(words, words[1:]) if a == b for u in (quality.AGAIN, quality.word_form(quality.AGAIN))]
    d = model.vectors.shape[1]
    x = [0.0] * (d + 1)
    for u in parts:
        v = model.vectors[zlib.crc32(u) % quality.TABLE]
        for j in range(d):
            x[j] += float(v[j]) / len(parts)
    x[d] = math.log1p(len(parts)) / 10 if parts else 0.0
    z = [(a - m) / s for a, m, s in zip(x, model.mean.tolist(), model.scale.tolist())]
    total = model.b2
    for k in range(len(model.w2)):
        h = float(model.b1[k]) + sum(a * float(w) for a, w in zip(z, model.w1[:, k]))
        total += max(h, 0.0) * float(model.w2[k])
    return 1 / (1 + math.exp(-min(30, max(-30, total / model.temperature))))


def test_scores_equal_the_slow_way(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.training_rows(docs, labels)
    model = quality.fit([t for t, _ in rows], [y for _, y in rows])
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    own = sorted((r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 2500)
    assert len(own) > 50
    for i, text in own[::3] + [(None, ""), (None, "a a a b")]:
        want = slow_score(model, text)
        if i is None:
            assert abs(quality.make(type("Shared", (), {"value": model}))({"text": [text], "doc_id": [i]})["score"][0] - want) < 1e-4
        else:
            assert abs(got[i] - want) < 1e-4, i


def test_scores_are_calibrated(spark):
    """On held-out rows: log loss well below that of the base rate, and scores that say how often labels are 1."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    y, p = [r.quality for r in rows], [min(1 - 1e-9, max(1e-9, r.score)) for r in rows]
    rate = sum(y) / len(y)
    loss = -sum(math.log(b if a else 1 - b) for a, b in zip(y, p)) / len(y)
    base = -(rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    assert loss < 0.5 * base
    assert abs(sum(p) / len(p) - rate) < 0.05
    bins = [[] for _ in range(5)]
    for a, b in zip(y, p):
        bins[min(4, int(b * 5))].append((a, b))
    gap = sum(abs(sum(a for a, _ in x) - sum(b for _, b in x)) for x in bins) / len(y)
    assert gap < 0.06
