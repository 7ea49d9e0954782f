"""Hand-made tables with every awkward case, and brute-force versions of the operators."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (None, "no id at all here", "en", "s", 17),
    (9001, None, None, None, None),
    (9002, "", "en", "s", 0),
    (9003, " \t\n ", "en", "s", 4),
    (9004, "12 345 -- !!", None, "s", 12),
    (9005, "one", "en", None, 3),
    (9006, "É Σ 日本 ſ\u0085x 'LL don't <|endoftext|> y", "fr", "s", 30),
    (9007, "same words again", "en", "s", 16),
    (9008, "same words again", "en", "s", 16),
]


@pytest.fixture(scope="session")
def words():
    """A made-up vocabulary for each of two languages."""
    rng = random.Random(4)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return {"en": make("abcdeghiklmnorst"), "fr": make("éèçouvxyzjpqw")}


@pytest.fixture(scope="session")
def corpus(words):
    """Prose of two languages with exact and near copies, shared passages, one long text and all awkward rows."""
    rng = random.Random(5)
    prose = lambda lang, n: [words[lang][min(int(rng.expovariate(1 / 60)), 299)] for _ in range(n)]
    passage = prose("en", 70)
    rows = []
    for i in range(160):
        lang = "fr" if i % 4 == 0 else "en"
        text = prose(lang, rng.randint(20, 150))
        if i % 10 == 1:
            at = rng.randrange(len(text))
            text[at:at] = passage
        if i % 10 == 2 and rows:
            source = rows[rng.randrange(len(rows))]
            text, lang = source[1].split(), source[2]
            for _ in range(rng.choice([0, 1, 2, 12])):
                text[rng.randrange(len(text))] = "changed"
        t = " ".join(text).capitalize()
        rows.append((i, t, lang, f"s{i % 3}", len(t)))
    long = " ".join(prose("en", 30_000))
    rows.append((500, long, "en", "s", len(long)))
    return rows + AWKWARD


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sf_dir(spark, corpus, docs, tmp_path_factory):
    """A folder of tables like the given ones."""
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in corpus if r[0] is not None and r[0] < 160 and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


class Groups:
    """Union of ids by smallest member."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.fixture(scope="session")
def groups():
    return Groups


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.fixture(scope="session")
def shingle_sets():
    return shingles
