import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + k for own in where.values() if len(own) > 1 for i in own for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(BLANKS)).lower()


def verdicts(rows, limits):
    """(doc_id, text, source) rows to verdicts and frequent lines, by brute force."""
    held, sites = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        sites[source].add(text)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                held[source, normal(line)].add(text)
    frequent = {k for k, own in held.items() if len(own) > limits.min_docs and len(own) > limits.max_share * len(sites[k[0]])}
    out = []
    for doc_id, text, source in rows:
        n, chars, signs, dup, repeat = base(text)
        failed = n < limits.min_words or 100 * repeat > limits.max_repeat * n
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (source, normal(x)) in frequent)
        left = n - gone
        out.append((doc_id, n, chars, signs, dup, repeat, failed, not failed and left >= limits.left_words and left >= limits.left_share * n, left))
    return Counter(out), frequent


LOW = quality_rules.Limits(min_words=10, min_docs=1, max_share=0.0, left_words=5)


@pytest.mark.parametrize("limits", [quality_rules.Limits(), LOW])
@pytest.mark.parametrize("table", ["odd", "docs"])
def test_quality(table, limits, request):
    df = request.getfixturevalue(table)
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    want, frequent = verdicts(rows, limits)
    got = quality_rules.quality_counts(df, limits).collect()
    assert Counter(tuple(r) for r in got) == want
    kept = quality_rules.quality_filter(df, limits)
    assert kept.columns == df.columns
    keep = Counter()
    for doc_id, text, source in rows:
        if next(v for v in want if v[0] == doc_id and v[1:6] == base(text))[7]:
            keep[doc_id, "\n".join(x for x in text.split("\n") if not (WORD.search(x) and (source, normal(x)) in frequent))] += 1
    found = kept.select("doc_id", "text", "n_chars").collect()
    assert Counter((r.doc_id, r.text) for r in found) == keep
    assert all(r.n_chars == len(r.text) for r in found)


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b c d", "x y z q x y z", "", "a b a b a", " a  b\tc\na b c"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_counts(df).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def fill(sizes, weights, share, most):
    """Targets by the rule as stated: shares by weight, capped, the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    whole, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        level = (whole - sum(target.values())) / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in full}
        free -= full
    return target


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_mixing(table, request):
    df = request.getfixturevalue(table)
    rows = mixing.mixed(df).collect()
    sizes, source_size = Counter(), Counter()
    for r in df.select("doc_id", "text", "source").collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.doc_id, n, r.source] += 1
        source_size[r.source] += n
    assert Counter((r.doc_id, r["size"], r.source) for r in rows) == sizes
    target = fill(source_size, (3, 1, 2), 1.5, 2.0)
    taken = Counter()
    for r in rows:
        assert r.source_size == source_size[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for (_, n, s), _ in sizes.items():
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert sorted(map(str, mixing.mixed(df.repartition(5)).collect())) == sorted(map(str, rows))
    out = mixing.mix(df)
    assert out.columns == df.columns
    want = Counter()
    for r in rows:
        want[r.doc_id, r["size"]] += r.copies
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in out.select("doc_id", "text").collect())
    assert got == +want


def test_mixing_prefers_weight(spark):
    df = spark.createDataFrame([(i, "one two three four", "a") for i in range(400)] + [(1000 + i, "x " * 4000, "b") for i in range(4)], "doc_id long, text string, source string")
    good = spark.createDataFrame([(i, 20.0) for i in range(100)] + [(5, 1.0), (7, -1.0), (None, 3.0)], "doc_id long, weight double")
    rows = mixing.mixed(df, weights=(1, 40), share=0.5, qualities=good).where("source = 'a'").collect()
    picked = [r.doc_id for r in rows if r.copies]
    assert 0 < len(picked) < 250 and sum(i < 100 for i in picked) > 0.6 * min(len(picked), 100)


def slow_dedup(rows, min_words):
    """Sentences by (id, text), and the places (id, text, number, size) of each run, by plain loops."""
    end = re.compile("(?:[.!?…][\"')\\]\u2018\u2019\u201c\u201d»]*[ \\t-\\r]+|\n[ \\t-\\r]*)")
    pieces, seen = {}, defaultdict(set)
    for doc_id, text in rows:
        if text is not None:
            at = [0, *(m.end() for m in end.finditer(text)), len(text)]
            pieces[doc_id, text] = p = [text[a:b] for a, b in zip(at, at[1:]) if b > a]
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    words = [WORD.findall(x.lower()) for x in p[i:j]]
                    if sum(map(len, words)) >= min_words:
                        if words[0]:
                            seen[tuple(tuple(w) for w in words if w)].add(((doc_id, text), i, j))
                        break
    return pieces, seen


@pytest.mark.parametrize("table,min_words", [("odd", 20), ("odd", 3), ("docs", 20), ("docs", 8)])
def test_substrings(table, min_words, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    pieces, seen = slow_dedup(rows, min_words)
    out = substring_dedup.passage_dedup(df, min_words)
    assert [c for c in out.columns if c != "n_removed"] == df.columns
    got = Counter((r.doc_id, r.text, r.n_removed) for r in out.collect())
    # The first of equal texts under different ids, and the tie of texts under one id, follow the text digest.
    tk = {(r.doc_id, r.text): r.tk for r in df.select("doc_id", "text", F.xxhash64("text", F.col("text").isNull()).alias("tk")).collect()}
    order = lambda place: ((place[0][0] is not None, place[0][0] or 0), tk[place[0]], place[1])
    gone = defaultdict(set)
    for places in seen.values():
        for key, i, j in sorted(places, key=order)[1:]:
            gone[key] |= set(range(i, j))
    want = Counter()
    for doc_id, text in rows:
        cut = gone[doc_id, text]
        left = None if text is None else "".join(x for k, x in enumerate(pieces[doc_id, text]) if k not in cut)
        want[doc_id, left, len((text or "").encode()) - len((left or "").encode())] += 1
    assert got == want and (table == "odd" or sum(n > 0 for _, _, n in want) > 2)


def test_hot_passage(spark):
    """A passage in most documents is joined apart; the result is the same."""
    passage = "It was the third winter of the long war, and the river had frozen from bank to bank. Soldiers crossed it by night, carrying lanterns. "
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage), F.lit("Now "), F.col("id"), F.lit(" ends.")).alias("text"))
    got = Counter((r.n_removed, r.text.startswith("Now")) for r in substring_dedup.passage_dedup(df).collect())
    assert got == {(len(passage), True): 5999, (0, False): 1}


def test_planted_passage(spark):
    passage = "It was the third winter of the long war, and the river had frozen from bank to bank. Soldiers crossed it by night, carrying lanterns. Nobody spoke, for the ice would answer every word. In the morning the villages on the far side were empty, and only the dogs were left to bark at the strangers who came walking out of the fog."
    docs = [(i, f"Document {i} opens in its own way, with words {i * 3} of its own. {passage} Then number {i} ends, quite differently from the {i + 7} others.") for i in range(6)]
    docs += [(100 + i, f"A clean text {i}. It shares nothing, save its shape {i * i}. So it must stay, all {i + 1} of it.") for i in range(6)]
    out = {r.doc_id: r for r in substring_dedup.passage_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].text == docs[0][1] and all(out[100 + i].n_removed == 0 for i in range(6))
    for i in range(1, 6):
        assert "frozen from bank" not in out[i].text and out[i].text.startswith(f"Document {i} opens") and "ends" in out[i].text


def test_passages_of_long_and_short_pieces(spark):
    """Repeated passages of 50 words: in 1 to 4 sentences, in one-word pieces, and with quotes or two blanks after the sentence ends."""
    words = [f"w{k * 37 % 101}x{k}" for k in range(51)]
    cut = lambda n, end: end.join(" ".join(words[k * 51 // n : (k + 1) * 51 // n]) for k in range(n))
    passages = [cut(n, ". ") for n in (1, 2, 3, 4)] + [" ".join(f"A{k % 7}B{k}!!" for k in range(51)), cut(6, ".  "), cut(6, '." ')]
    for passage in passages:
        docs = [(k, f"Text {k} begins its own way, {k}. {passage}. It ends, {k * 11}, in another one.") for k in range(3)]
        docs += [(9, "So it goes. A, b, c. So it goes. A, b.")]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        out = {r.doc_id: r for r in substring_dedup.passage_dedup(df).collect()}
        assert out[0].text == docs[0][1] and out[9].text == docs[3][1]
        for k in (1, 2):
            left = set(out[k].text.split())
            assert out[k].text.startswith(f"Text {k} begins") and f"{k * 11}," in left
            assert len(left & set(passage.split())) <= 3, (passage, out[k].text)


def test_nothing(empty, spark):
    assert quality_rules.quality_counts(empty).count() == 0 and quality_rules.quality_filter(empty).count() == 0
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert substring_dedup.passage_dedup(empty).count() == 0
