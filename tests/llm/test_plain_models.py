"""The fitted operators' decisions against plain versions: features, look-ups and sums of the classifier; ranks and distances of languages."""

import math
import re
from bisect import bisect_right
from collections import Counter

from tidemark.llm import language, quality
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "One word", "no no NO yes\nno no\nno no", "|| !? #$% 12 É中.\n", "x\n" * 50, "a b c a b c a b c " * 3000, "line\nline\nline", "\n\n\nend"]


def plain_features(text):
    """Shares are taken in the operator's own order of steps: cuts lie on values of the data, so the last bit counts."""
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    if not words:
        return [0.0] * len(quality.FEATURES)
    size, count = len(raw), len(words)
    share = lambda pattern: len(re.findall(pattern, raw)) / size
    triples = [tuple(words[i : i + 3]) for i in range(count - 2)]
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    return [
        math.log1p(count), (1 - share(rb"[\x20\x09-\x0D]")) * size / count, share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"[^A-Za-z0-9\x20\x09-\x0D\x80-\xff]"), share(rb"\|"), share(rb"[!?]"), share(rb"[#$%&*@^~<>{}=\\_]"), share(rb"[\x80-\xff]"), share(rb"\."),
        math.log1p(count / (share(rb"\n") * size + 1)), len(set(words)) / count, sum(a == b for a, b in zip(words, words[1:])) / count, max(Counter(words).values()) / count, 1 - len(set(triples)) / max(len(triples), 1), 1 - len(set(lines)) / len(lines),
    ]


def plain_score(model, x):
    z = model.base + sum(t[bisect_right(list(c), v)] for c, t, v in zip(model.cuts, model.tables, x))
    for i, j, grid in model.pairs:
        z += grid[bisect_right(list(model.coarse[i]), x[i])][bisect_right(list(model.coarse[j]), x[j])]
    return 1 / (1 + math.exp(-z))


def test_quality_scores(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    assert len(model.pairs) == quality.PAIRS and len(model.tables) == len(quality.FEATURES)
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = quality.classify(docs.select("doc_id", "text").union(odd), model).collect()
    assert len(rows) == docs.count() + len(ODD)
    for r in rows:
        want = plain_score(model, plain_features(r.text))
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.predicted == (r.score >= quality.THRESHOLD), r.doc_id


def test_a_score_is_the_text_s_own(spark):
    """Short texts alone in their chunk score as they do among others."""
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    together = {r.doc_id: r.score for r in quality.classify(df.coalesce(1), model).collect()}
    for i, t in enumerate(ODD[:6]):
        assert quality.classify(spark.createDataFrame([(i, t)], df.schema), model).first().score == together[i]


def plain_ranks(text_codes, k):
    return [g for g, _ in sorted(Counter(text_codes).items(), key=lambda x: (-x[1], x[0]))][:k]


def test_language_distances(spark):
    """With short profiles too, where ties at the last rank count."""
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").collect()]
    train = table(spark, SF, "documents").where(~language.held_out())
    held = {r.doc_id for r in table(spark, SF, "documents").where(language.held_out()).collect()}
    for k in (language.PROFILE, 20):
        learned = language.profiles(train, k=k)
        totals = {}
        for i, t, lang in docs:
            if i not in held:
                totals.setdefault(lang, Counter()).update(language.grams(t or "").tolist())
        assert learned == {x: plain_ranks(n, k) for x, n in totals.items()}
        place = {x: {g: at for at, g in enumerate(v)} for x, v in learned.items()}
        for r in language.identify(table(spark, SF, "documents"), learned, k=k).collect():
            own = plain_ranks(language.grams(r.text or "").tolist(), k)
            if not own:
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            far = {x: sum(abs(at - p[g]) if g in p else k for at, g in enumerate(own)) for x, p in place.items()}
            best = min(sorted(far), key=far.get)
            assert r.lang_pred == best and math.isclose(r.score, 1 - far[best] / (k * len(own))), r.doc_id
