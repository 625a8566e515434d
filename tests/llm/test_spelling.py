from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from tests.llm.helpers import edge, labels, nothing  # noqa: F401
from codeveritas.llm import queries, spelling as s

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, plant=True):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if plant and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o))
        if words[best] >= 5 * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out[w] = (f, root, n, len(near[w]), words[f] if f else None)
    return out


def texts(seed=2):
    """Words with variants one and two edits away, at counts that make chains of forms."""
    draw = random.Random(seed)
    letters = "abcdeéßñ×"
    rows, stock = [], []
    for _ in range(25):
        w = "".join(draw.choice(letters) for _ in range(draw.randint(6, 11)))
        n = draw.choice([150, 700])
        while n >= 4:
            stock += [w if draw.random() < 0.9 else w.title()] * n
            k, c = draw.randrange(len(w)), draw.choice(letters)
            w = draw.choice([w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:]])
            n //= draw.choice([1, 5, 5, 6])
    draw.shuffle(stock)
    for k in range(0, len(stock), 60):
        rows.append((k, draw.choice([" ", ", ", "\n", "1", "_"]).join(stock[k : k + 60])))
    return rows + [(None, None), (None, "Ünicode ünicode " * 5), (3, ""), (4, "12 ..."), (5, "a" * 3000 + " " + "a" * 2999)]


def answer(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_brute_force(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    want = brute(rows)
    assert answer(got) == want
    assert any(f for f, *_ in want.values()) and any(r != f and f for f, r, *_ in want.values())


def test_signatures_lose_no_pair():
    draw = random.Random(4)
    for _ in range(3):
        part = s.deal([(ord(c), k, draw.randint(1, 90)) for c in "abcdeé" for k in range(3)], 100)
        pairs = []
        for _ in range(400):
            w = "".join(draw.choice("abcdeéz") for _ in range(draw.randint(6, 30)))
            k, c = draw.randrange(len(w)), draw.choice("abxé")
            v = draw.choice([w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])
            pairs.append((w, v))
        left, right = (s.signatures(list(x), part) for x in zip(*pairs))
        assert ((left == right).any(axis=1)).all()


def test_no_signature_is_shared_by_many(spark):
    """A vocabulary of anagrams: candidates stay far below all pairs."""
    draw = random.Random(1)
    words = sorted({"".join(draw.sample("abcdefghij", 10)) for _ in range(2000)})
    rows = [(k, " ".join([w] * 5)) for k, w in enumerate(words)]
    got = answer(s.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got) == len(words) and all(v == (None, w, 5, 0, None) for w, v in got.items())


def test_edge_cases(spark, edge, nothing):
    got = s.variants(edge, least_count=1)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert answer(got) == {"a" * 5000: (None, "a" * 5000, 1, 0, None), "without": (None, "without", 1, 0, None)}
    assert s.variants(nothing).count() == 0
    repeated = s.variants(edge.unionByName(edge).unionByName(edge), least_count=3)
    assert answer(repeated)["without"][2] == 3


def test_no_table_is_broadcast(spark):
    """Spark sizes what comes out of Arrow batches like their input, 20 signatures of a word like the word."""
    words = [f"{a}{b}rmations" for a in ("info", "infos", "confi", "trans") for b in "abcdefg"]
    df = spark.createDataFrame([(k, " ".join(words * 5)) for k in range(3)], "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    vocabulary = s.write_and_read(s.word_counts(df), "spelling-words")
    assert "Broadcast" not in plan(s.near_words(vocabulary)) and "SortMergeJoin" in plan(s.near_words(vocabulary))
    assert "Broadcast" not in plan(s.variants(df))
