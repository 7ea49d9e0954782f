"""Plain versions of the models, a few lines each, against what the operators give."""

import math
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import fingerprints, language_id, quality, suffix_tree


def words_of(text):
    return (text or "").encode().lower().split()


class PlainKneserNey:
    """Interpolated modified Kneser-Ney trigrams over dictionaries."""

    def __init__(self, texts):
        counts = Counter(w for t in texts for w in words_of(t))
        self.vocabulary = {w for w, n in counts.items() if n > 1}
        self.unknown = 1 / (1 + sum(n == 1 for n in counts.values()))
        three = Counter(g for t in texts for g in self.grams(t))
        before = defaultdict(set)
        for a, b, c in three:
            before[b, c].add(a)
        two = {(b, c): sum(three[a, b, c] for a in s) if b == "<s>" else len(s) for (b, c), s in before.items()}
        one = Counter(c for _, c in two)
        self.p3, self.g3 = self.level({(g[:2], g[2]): n for g, n in three.items()})
        self.p2, self.g2 = self.level({((b,), c): n for (b, c), n in two.items()})
        d, total = self.discounts(one.values()), sum(one.values())
        kinds = len(self.vocabulary) + 3  # with the unknown word, the start and the end
        self.p1 = {c: (n - d[min(n, 3)]) / total for c, n in one.items()}
        self.spare = max(0.0, 1 - sum(self.p1.values())) / (kinds - 1)

    def grams(self, text):
        seq = ["<s>", "<s>", *(w if w in self.vocabulary else "<unk>" for w in words_of(text)), "</s>"]
        return zip(seq, seq[1:], seq[2:])

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        if not n[1]:
            return [0.0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3)]
        return [0.0, *(min(max(x, 0.1), i - 0.1) for i, x in zip((1, 2, 3), d))]

    def level(self, counts):
        d, total, p, rest = self.discounts(counts.values()), Counter(), {}, {}
        for (context, _), n in counts.items():
            total[context] += n
        for (context, c), n in counts.items():
            p[context, c] = (n - d[min(n, 3)]) / total[context]
            rest[context] = rest.get(context, 1.0) - p[context, c]
        return p, rest

    def log_p(self, text):
        out = 0.0
        for a, b, c in self.grams(text):
            short = self.p2.get(((b,), c), 0.0) + self.g2.get((b,), 1.0) * (self.p1.get(c, 0.0) + self.spare)
            p = self.p3.get(((a, b), c), 0.0) + self.g3.get((a, b), 1.0) * short
            out += math.log(p * (self.unknown if c == "<unk>" else 1.0))
        return out


def test_perplexity_and_limits_equal_plain_kneser_ney(docs, corpus, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda sample: seen.extend(r.text for r in sample.collect()) or fit(sample))
    trusted = docs.filter("doc_id < 160 AND doc_id % 2 = 0").select("doc_id")
    got = quality.rate_documents(docs, trusted, per_lang=25).collect()
    plain = PlainKneserNey(seen)
    text = {r[0]: r[1] for r in corpus}
    assert len(got) == len(corpus) and 20 < len(seen) <= 75
    for r in got:
        n = len(words_of(text[r.doc_id])) + 1
        assert r.n_tokens == n and math.log(r.perplexity) == pytest.approx(-plain.log_p(text[r.doc_id]) / n, rel=2e-6)
    learned = Counter(seen)
    unseen = defaultdict(list)
    for r in got:
        if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 2 == 0 and not learned[text[r.doc_id]]:
            unseen[r.lang].append(math.log(r.perplexity))
    for lang in ("en", "fr"):
        values = sorted(unseen[lang])
        limit = values[math.ceil(quality.QUANTILE * len(values)) - 1] + math.log(quality.SLACK)
        for r in got:
            if r.lang == lang:
                assert math.log(r.threshold) == pytest.approx(limit) and r.kept == (math.log(r.perplexity) <= limit)


class PlainSuffixTree:
    """Contexts of up to three words in dictionaries, all that occur often enough."""

    def __init__(self, texts, least, pull):
        self.words = Counter(w for t in texts for w in words_of(t))
        self.least, self.pull = least, pull
        seen = Counter(self.words.values())
        self.rare, self.nexts = seen[1] + 2 * seen[2], defaultdict(Counter)
        for t in texts:
            learned = ["<unk>" if self.words[w] == 1 else self.symbol(w) for w in words_of(t)] + ["</s>"]
            for i, d in enumerate(learned):
                for depth in range(min(i, 3) + 1):
                    self.nexts[tuple(learned[i - depth : i])][d] += 1
        self.tokens = sum(self.nexts[()].values())
        self.kinds = 3 + sum(n > 2 for n in self.words.values())
        self.kept = {}

    def symbol(self, w):
        return w if self.words[w] > 2 else "<rare>" if self.words[w] else "<unk>"

    def p(self, context, d):
        if not context:
            return (self.nexts[()][d] + 0.5) / (self.tokens + 0.5 * self.kinds)
        short, counts = self.p(context[1:], d), self.nexts.get(context, {})
        total = sum(counts.values())
        if context not in self.kept:
            loo = lambda n, q: n * math.log((n - 1 + self.pull * q) / (total - 1 + self.pull) / q)
            gain = math.inf if len(context) == 1 else sum(loo(n, self.p(context[1:], x)) for x, n in counts.items()) if total >= self.least else 0
            self.kept[context] = total >= self.least and gain > 0.5 * math.log(max(self.tokens, 2))
        return (counts.get(d, 0) + self.pull * short) / (total + self.pull) if self.kept[context] else short

    def log_p(self, text):
        words, out = words_of(text), 0.0
        context = ["<unk>" if self.words[w] == 1 else self.symbol(w) for w in words]
        for i, d in enumerate([*map(self.symbol, words), "</s>"]):
            out += math.log10(self.p(tuple(context[max(0, i - 3) : i]), d))
            if d == "<rare>":
                out += math.log10(self.words[words[i]] / self.rare)
        return out


def test_suffix_tree_scores_equal_a_plain_tree_over_all_words(spark, docs, corpus, monkeypatch):
    learn = language_id.remainder(F.col("doc_id"), 7) != 2
    monkeypatch.setattr(suffix_tree, "PAIRS_BUCKET", 2_000)
    got = suffix_tree.score_documents(docs.withColumn("learn", learn), least=8, pull=4.0).collect()
    text = {r[0]: r[1] for r in corpus}
    plain = PlainSuffixTree([text[r.doc_id] for r in got if r.learned], 8, 4.0)
    assert len(got) == len(corpus)
    for r in got:
        assert r.score == pytest.approx(plain.log_p(text[r.doc_id]), rel=1e-6)
    lengths = Counter(len(c) for c, kept in plain.kept.items() if kept)
    assert min(lengths[1], lengths[2], lengths[3]) > 5


def test_suffix_tree_learns_contexts_of_words_that_are_not_frequent(spark):
    """Twenty words that each come thirty times, after six hundred more frequent ones."""
    rng = np.random.default_rng(3)
    common = " ".join(f"w{i}" for i in rng.permutation(np.repeat(np.arange(600), 40)))
    pairs = " ".join(f"key{i} value{i}" for i in rng.permutation(np.repeat(np.arange(20), 30)))
    rows = [(1, common, True), (2, pairs, True), (3, " ".join(f"key{i} value{i}" for i in range(20)), False), (4, " ".join(f"key{i} value{(i + 7) % 20}" for i in range(20)), False)]
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string, learn boolean")).collect()}
    assert got[3] > got[4] + 20


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text, bins=fingerprints.BINS, size=fingerprints.SHINGLE):
    """One-permutation MinHash with rendezvous densification and low bytes."""
    words = words_of(text)
    if not words:
        return ""
    chain = lambda parts: reduce(lambda seed, p: xxhash.xxh64_intdigest(p, seed), parts, 42)
    runs = [[b" ".join(words)]] if len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    least = {}
    for h in (chain(r) for r in runs):
        b = h >> (64 - bins.bit_length() + 1)
        least[b] = min(least.get(b, math.inf), signed(h))
    number = lambda n: n.to_bytes(4, "little")
    own = lambda b: least[b] if b in least else least[min(least, key=lambda o: (signed(chain([number(b), number(o)])), least[o]))]
    return "".join(f"{own(b) & 255:02x}" for b in range(bins))


def test_fingerprints_equal_a_plain_version(docs, corpus):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    rows = sorted((r[0], r[1] or "") for r in corpus if r[0] is not None)
    prints = {i: plain_fingerprint(t) for i, t in rows}

    def alike(a, b):
        if a == b or not a or not b:
            return float(a == b)
        share = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, len(a), 2)) / fingerprints.BINS
        return min(max((share - 1 / 256) / (1 - 1 / 256), 0.0), 1.0)

    for (i, t), (j, after) in zip(rows, rows[1:] + rows[:1]):
        edited = plain_fingerprint(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (prints[i], edited)
        assert got[i].near_edited == pytest.approx(alike(prints[i], edited)) and got[i].near_next == pytest.approx(alike(prints[i], prints[j]))


def plain_buckets(text):
    codes = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    letter = [c != 32 for c in codes]
    out, m = [], (1 << 32) - 1
    for size in range(1, 5):
        for i in range(len(codes) - size + 1):
            w = letter[i : i + size]
            if not (w[0] or w[1] if size == 2 else w[0] if size == 1 else w[1] if size == 3 else w[1] and w[2]):
                continue
            key = 0
            for c in codes[i : i + size]:
                key = (key * 0x01000193 + c) & m
            x = ((key + size) * 0x9E3779B1) & m
            out.append((((x ^ (x >> 15)) * 0x85EBCA77) & m) >> 17)
    return out


def plain_language(model, text):
    """Shares of the languages; none without a letter."""
    if not any(c.isalpha() for c in text or ""):
        return None
    z = (np.mean([model.table[b].astype(float) for b in plain_buckets(text)], axis=0) + model.bias) / model.temperature
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_predicted_languages_equal_a_plain_average(docs, corpus):
    model = language_id.fit(docs.filter("doc_id < 100").select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for i, text, *_ in corpus[:60] + corpus[-9:]:
        p = plain_language(model, text)
        if p is None:
            assert got[i].lang_pred == "und"
            continue
        assert got[i].lang_pred == model.langs[int(p.argmax())] and got[i].score == pytest.approx(p.max(), rel=1e-6)
        assert got[i].accepted == (p.max() >= model.threshold) or abs(p.max() - model.threshold) < 1e-9


def plain_repeats(rows, size=50):
    """Texts without the words of windows whose first equal one lies in an earlier document or ends before."""
    first, cut = {}, defaultdict(set)
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        w = words_of(text)
        for s in range(len(w) - size + 1):
            d, p = first.setdefault(tuple(w[s : s + size]), (i, s))
            if d != i or s - p >= size:
                cut[i].update(range(s, s + size))
    out = {}
    for i, text, *_ in rows:
        if cut.get(i):
            data = text.encode()
            begins = [m.start() for m in re.finditer(rb"[^ \t-\r]+", data)]
            kept = [data[: begins[0]]] + [data[a:b] for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(data)])) if k not in cut[i]]
            text = b"".join(kept).decode()
            if not words_of(text):
                continue
        out[i] = text
    return out


def test_pipeline_stages_equal_plain_versions(spark, docs, sf_dir, corpus, groups, shingle_sets, monkeypatch):
    """Each stage on what the one before it kept, against a plain version of it; packing has its own plain version."""
    table = lambda df: [tuple(r) for r in df.collect()]
    frame = lambda rows: spark.createDataFrame(rows, docs.schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    # Language.
    out = table(stages["language"](spark, docs, sf_dir))
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    fits = lambda text: (p := plain_language(model, text)) is not None and p.max() >= model.threshold - 1e-9
    short = [r for r in corpus if len(r[1] or "") < 5000]
    assert {r[0] for r in out if r[0] != 500} == {r[0] for r in short if fits(r[1])}
    # Quality.
    rows, seen, fit = out, [], quality.fit
    with monkeypatch.context() as m:
        m.setattr(quality, "fit", lambda sample: seen.extend(r.text for r in sample.collect()) or fit(sample))
        out = table(stages["quality"](spark, frame(rows), sf_dir))
    plain, unseen = PlainKneserNey(seen), defaultdict(list)
    log_ppl = {r[0]: -plain.log_p(r[1]) / (len(words_of(r[1])) + 1) for r in rows}
    for r in rows:
        if r[0] is not None and r[0] < 160 and r[0] % 2 == 0:
            unseen[r[2]].append((log_ppl[r[0]], r[1] in seen))
    every = sorted(x for v in unseen.values() for x, _ in v)
    cut = lambda values: values[math.ceil(quality.QUANTILE * len(values)) - 1] + math.log(quality.SLACK)
    limit = {lang: cut(sorted(x for x, known in v if not known)) for lang, v in unseen.items() if any(not known for _, known in v)}
    assert {r[0] for r in out} == {r[0] for r in rows if r[0] is None or log_ppl[r[0]] <= limit.get(r[2], cut(every)) + 1e-6}
    # Near duplicates.
    rows = out
    out = table(stages["near_duplicates"](spark, frame(rows), sf_dir))
    sets = {r[0]: shingle_sets(r[1], 5) for r in rows if r[0] is not None}
    found = groups(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                found.join(a, b)
    assert sorted((r[0] is not None, r[0] or 0) for r in out) == sorted((r[0] is not None, r[0] or 0) for r in rows if r[0] is None or found.find(r[0]) == r[0])
    # Repeats.
    rows = out
    out = table(stages["repeats"](spark, frame(rows), sf_dir))
    assert {r[0]: r[1] for r in out} == plain_repeats(rows)
    assert any(len(r[1]) != len(dict((x[0], x[1]) for x in rows)[r[0]]) for r in out)
    # Packing: every token of every document, once.
    packed = stages["packing"](spark, frame(out), sf_dir).collect()
    assert sum(r.n_tokens for r in packed) == sum(len(words_of(r[1])) + 1 for r in out)
