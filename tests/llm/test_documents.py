"""Operators on documents against brute force, and their defined results on awkward input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from duck import oracle, same

from tracewright.llm import decontam, langid, lines, minhash, mixing, mpeg, queries, sharding
from tracewright.llm.common import Scratch
from tracewright.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, lang_pred string, keys string"


def frame(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(*r, 1, "mine", "mine", "mine", "mine") for r in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "b"),
    (3, " \n\t ", None, None),
    (4, "12 ,.!", "en", "a"),
    (5, LONG, "en", "a"),
    (6, LONG + " more words here", "en", None),
    (None, "a text without an id", None, "c"),
    (7, "repeated row", "en", "a"),
    (7, "repeated row", "en", "a"),
    (8, "😀 emoji éè only".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "b"),
    (9, "short", "en", "b"),
]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, small, name):
    same(queries.QUERIES[name](spark, small).toPandas(), oracle(queries.ORACLES[name], small))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, small, tmp_path, name):
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# --- language -----------------------------------------------------------------------------------


def test_held_out_accuracy(spark, small):
    out = queries.QUERIES["op5_language_id"](spark, small).toPandas()
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").toPandas()
    m = out.merge(truth, on="doc_id")
    held = m[m.held_out]
    assert len(held) > 40 and (held.lang == held.lang_pred).mean() > 0.97
    assert ((m.score >= 0) & (m.score <= 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(m.doc_id, m.held_out, strict=True))


def test_scores_are_those_of_the_kernel(spark):
    """Kernel, Nystroem map and ridge regression one by one, with sets of n-grams, give what the multiplied-out weights give."""
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    vocabulary = {"de": "das ist ein Haus und der Hund".split(), "en": "this is a house and the dog".split(), "fr": "ceci est une maison et le chien".split()}
    rows = [(i, say(vocabulary[k], 3 + i % 9), k) for i, k in enumerate(list(vocabulary) * 8)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = lambda t: {t.lower()[i : i + n] for n in range(1, 6) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    marks = [t for _, t, _ in rows]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k_mm)
    phi = k_mm @ (vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T)
    target = np.array([[k == x for x in model.langs] for *_, k in rows], dtype=float)
    weight = np.linalg.solve(phi.T @ phi + 0.1 * np.eye(len(marks)), phi.T @ target)
    half = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    for t in ("the dog is a house", "das Haus", "une maison est un chien", "x"):
        want = np.array([kernel(t, m) for m in marks]) @ half @ weight
        langs, scores = langid.predict(model, [t])
        assert langs == [model.langs[want.argmax()]] and abs(scores[0] - min(1, max(0, want.max()))) < 2e-3, (t, want, scores)


def test_presence_in_windows_and_on_the_wire(monkeypatch):
    """Cut into windows a text has the n-grams that it has whole; what is shipped as numbers or bits comes back."""
    texts = ["", "a", "ab" * 50, "".join(chr(97 + i * i % 26) for i in range(1000)), "short one"]
    want = langid.presence(texts)
    for size in (7, 64, 999):
        monkeypatch.setattr(langid, "PIECE", size)
        assert all((a == b).all() for a, b in zip(want, langid.presence(texts), strict=True))
    dense = np.arange(0, 1 << langid.BITS, 3)
    assert all((langid._received(langid._shipped(g)) == g).all() for g in (*want, dense)) and len(langid._shipped(dense)) == 1 << langid.BITS - 3


def test_every_language_is_learned(spark, monkeypatch):
    """300 languages, one of most rows: none is left out, and blocks of them give what one matrix gives."""
    words = [f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou" for c in "stvxzc"]
    rows = [(i, f"{words[i % 300]} {words[i % 300][::-1]} {words[i % 300]}{words[i % 300]} and more", f"l{i % 300:03}" if i % 7 else "en") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.langs) == 301 and model.weights.shape[1] == 301
    want = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).select("doc_id", "lang_pred", "score").collect()}
    assert {k for _, k, _ in want} >= {f"l{i:03}" for i in range(300)}
    texts = dict((i, t) for i, t, _ in rows)
    for at, lang, score in sorted(want)[:50]:
        assert ([lang], [score]) == langid.predict(model, [texts[at]])
    monkeypatch.setattr(langid, "LANGS", 1000)
    assert want == {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).select("doc_id", "lang_pred", "score").collect()}
    none = langid.identify(spark.createDataFrame([(1, None), (2, "12"), (3, "bas")], "doc_id long, text string"), langid.Model(model.langs, model.weights)).collect()
    assert [(r["lang_pred"], r["score"]) for r in none][:2] == [("und", 0.0)] * 2 and none[2]["lang_pred"] != "und"


def test_odd_languages(spark):
    docs = frame(spark, ODD)
    out = langid.identify(docs, langid.learn(docs)).toPandas()
    assert len(out) == len(ODD) and "size" in out.columns
    und = set(out[out.lang_pred == "und"].doc_id.dropna())
    assert und == {1, 2, 3, 4}
    none = langid.identify(docs, langid.learn(docs.limit(0))).toPandas()
    assert set(none.lang_pred) == {"und"}


# --- near-duplicates ----------------------------------------------------------------------------


def brute_components(rows, sets, percent=80):
    """doc_id -> least doc_id reachable by links, all pairs compared."""
    ids = [i for i in dict.fromkeys(rows) if sets[i]]
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in rows}


def word_sets(texts, size):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    return out


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_duplicates_equal_brute_force(spark):
    """Groups of copies with few to many edits, of sets small and large, around the threshold."""
    rng = random.Random(5)
    texts, doc = {}, 0
    for size in (3, 6, 12, 30, 100, 128, 140, 400):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            texts[doc] = " ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.05, 0.08])))
            doc += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(list(texts), word_sets(texts, 5))


def test_hot_group_and_odd_rows(spark):
    rows = [*ODD, *[(100 + i, "the very same words in many documents over and over", "en", "a") for i in range(300)]]
    out = minhash.near_duplicates(frame(spark, rows)).toPandas()
    assert len(out) == len(rows)
    by = out.set_index("doc_id").component_id.to_dict()
    assert {by[100 + i] for i in range(300)} == {100}
    assert by[5] == by[6] == 5 and by[1] == 1 and by[2] == 2 and by[3] == 3
    sizes = out.set_index("doc_id").n_shingles.to_dict()
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[9] == 1
    assert out[out.doc_id.isna()].component_id.isna().all() and out[out.doc_id.isna()].kept.all()
    assert out.kept.sum() == out[~out.doc_id.isin([6, *range(101, 400)])].shape[0]


def test_registers_estimate():
    rng = np.random.default_rng(0)
    for j in (0.8, 0.5):
        u = rng.integers(0, 2**63, 1000).astype(np.uint64)
        k = int(j * 1000)
        h = (1000 - k) // 2
        a, b = np.unique(u[: k + h]), np.unique(np.r_[u[:k], u[k + h :]])
        found = minhash.estimate(minhash.registers(a, minhash.Scheme())[None], minhash.registers(b, minhash.Scheme())[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(found[0] - j) < 0.15


def test_estimates_have_the_mean_and_spread_of_independent_buckets():
    rng, found = np.random.default_rng(1), []
    for _ in range(200):
        u = rng.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.unique(u[:900]), np.unique(np.r_[u[:800], u[900:]])
        found.append(minhash.estimate(minhash.registers(a, minhash.Scheme())[None], minhash.registers(b, minhash.Scheme())[None], np.array([900]), np.array([900]))[0])
    assert abs(np.mean(found) - 0.8) < 0.01 and np.std(found) < 0.045


def test_near_copies_around_the_threshold_equal_brute_force(spark):
    """One large family of which many members are barely linked or not, and texts that hold another whole: all by brute force."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(220)]
    texts = {i: " ".join(edited(rng, base, rng.choice([0.015, 0.02, 0.022, 0.025, 0.03]))) for i in range(400)}
    texts |= {1000 + i: " ".join(base[: 220 - 11 * i] + [f"x{i}y{k}" for k in range(9 * i)]) for i in range(15)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    want = brute_components(list(texts), word_sets(texts, 5))
    assert 20 < len(set(want.values())) < 400
    assert got == want


def test_one_id_with_two_texts_links_both(spark):
    """Document 2 comes with two texts, near to document 1 and to document 3: no link is lost, in any order of rows."""
    words = lambda c: [f"{c}{i}" for i in range(60)]
    a, b = words("a"), words("b")
    rows = [(1, a), (2, [*a[:-1], "x"]), (2, [*b[:-1], "y"]), (3, b), (4, ["other", "words"]), (4, ["unlike", "them"])]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in order], "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
        assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True)]


def test_cell_counts_are_those_of_all_sets(spark):
    rng = np.random.default_rng(3)
    held = [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(40)] + [np.arange(0, 2**40, 2**31, dtype=np.uint64) * np.uint64(2**23)] * 3
    rows = spark.createDataFrame([(x.tobytes(),) for x in held], "d binary").repartition(5)
    got = minhash._cell_counts(rows, lambda b: (np.frombuffer(x, dtype=np.uint64) for x in b.column(0).to_pylist()))
    want = np.zeros(1 << minhash.CELLS, dtype=np.int64)
    for x in held:
        np.add.at(want, minhash._cells(x), 1)
    assert (got == want).all() and want.max() > 1


def test_cell_counts_come_to_the_driver_as_bytes_in_order(spark):
    counts = np.unique(np.r_[np.arange(300), np.geomspace(300, 2**40, 4000).astype(np.int64)])
    got = minhash._in_a_byte(counts)
    assert got.dtype == np.uint8 and (np.diff(got.astype(int)) >= 0).all() and (got[:128] == np.arange(128)).all() and got[-1] == 255
    rows = spark.createDataFrame([(np.array([7], dtype=np.uint64).tobytes(),)] * 1000, "d binary").repartition(4)
    often = minhash._cell_counts(rows, lambda b: (np.frombuffer(x, dtype=np.uint64) for x in b.column(0).to_pylist()))
    assert often.nbytes == 1 << minhash.CELLS and often[0] == minhash._in_a_byte(np.array([1000]))[0] and often[1:].max() == 0


def test_members_meet_their_labels_once_a_step(spark, monkeypatch):
    """Of large buckets: one outer join a step, whose rows grow with the members and not with their square."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(60)]
    met, keep = [], Scratch.keep

    def watched(self, df, label):
        out = keep(self, df, label)
        if n := df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter, (id"):
            assert n == 1, label
            met[-1].append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", watched)
    for lines_ in (150, 300):
        met.append([])
        texts = [" ".join([*words[:40], words[rng.randrange(60)], str(i)]) for i in range(lines_)]
        decided = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert sum(len(r["kept"]) for r in decided.collect()) == 1
    few, many = met
    assert 0 < sum(few) <= 3 * 16 * 150 and sum(many) <= 3 * sum(few), met


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr("tracewright.llm.components.LAST", 3)  # the distributed rounds do the work
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (2, 3), (500, None)]
    keep = Scratch(spark)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    keep.clear()
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


# --- lines --------------------------------------------------------------------------------------


def decisions(decided):
    """(doc_id, place) -> whether the line stays."""
    return {(r["doc_id"], k): k in r["kept"] for r in decided.collect() for k in range(r["n_lines"])}


@pytest.mark.parametrize("bits", [64, 10])
def test_lines_equal_brute_force(spark, small, bits):
    """Of 10 bits most lines share theirs with another, so that links come from the pass for such lines."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(120)
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    docs = spark.createDataFrame([*texts, (10**6, "A brand new line of words, fuzzy enough to count here\n\nA brand new line of words, fuzzy enough to count hers"), (10**6 + 1, None)], "doc_id long, text string")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.where("text is not null").collect())
    first, every = {}, []
    for i, t in texts:
        for k, line in enumerate(t.split("\n")):
            norm = " ".join(line.lower().split())
            every.append((i, k, norm))
            if norm:
                first.setdefault(norm, (i, k))
    order = {n: j for j, (n, _) in enumerate(sorted(first.items(), key=lambda x: x[1]))}
    sets = {j: {n[a : a + 8] for a in range(len(n) - 7)} or {n} for n, j in order.items()}
    by_shingle, near = defaultdict(list), {j: j for j in sets}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for j, s in sets.items():
        shared = Counter(k for g in s for k in by_shingle[g])
        for k, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[k]) - c):
                near[max(root(j), root(k))] = min(root(j), root(k))
        for g in s:
            by_shingle[g].append(j)
    owner = {n: root(j) for n, j in order.items()}
    place = {j: first[n] for n, j in order.items()}
    want = {(i, k): not n or place[owner[n]] == (i, k) for i, k, n in every}
    decided = lines.dedup_lines(docs, bits=bits)
    assert decisions(decided) == want
    text = {r["doc_id"]: r["text"] for r in lines.rebuilt(docs, decided).collect()}
    assert text[10**6] == "A brand new line of words, fuzzy enough to count here\n" and text[10**6 + 1] is None


def test_line_registers_are_those_of_line_sets(monkeypatch):
    """Made for many lines at once, and for lines cut into windows, registers are those of each line's own set."""
    rng, scheme = random.Random(3), lines.SCHEME
    texts = ["".join(rng.choice("abcdé 😀") for _ in range(n)) for n in (8, 9, 40, 1000, 31, 200)]
    for window in (1 << 18, 64, 16):
        monkeypatch.setattr(lines, "WINDOW", window)
        got, _ = lines.signed(texts, scheme)
        assert all((g == minhash.registers(scheme.shingles(t.encode()), scheme)).all() for g, t in zip(got, texts, strict=True))


def test_lines_of_few_shingles_take_the_exact_way():
    few = lambda t: bool(len(lines._small_keys([t.encode()], lines.SCHEME)[0]) and (len(t) < 27 or lines.signed([t], lines.SCHEME)[1][0]))
    assert few("a" * 500) and few("ab" * 40 + "x") and few("short")
    assert not few("".join(chr(97 + i % 25) for i in range(80)))
    for n in range(25, 34):
        assert few("".join(map(chr, range(100, 100 + n)))) == (n - 7 <= 24)


def test_repetitive_and_hot_lines(spark):
    """Rules of one character, a hot line in most documents, its near copies, and lines of equal shingles."""
    hot = "subscribe to our newsletter to get all the news of the day in your mailbox"
    rows = [(i, f"{hot}\nthis is line number {i * 7919} of its own kind, unlike others {i * i * 31}\n{'-' * (40 + i % 3)}") for i in range(200)]
    rows += [(1000 + i, f"{hot} x{i}") for i in range(30)]
    out = decisions(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(out) == 630 and out[0, 0] and out[0, 2]
    assert not any(v for (_, p), v in out.items() if p == 2 and _ > 0)
    assert not any(v for (d, p), v in out.items() if p == 0 and d > 0)


def test_small_buffers_and_one_id_with_two_texts(spark, monkeypatch):
    """Keys that go out from many buffers, and places told apart by the text they are in."""
    monkeypatch.setattr(lines, "BUFFER", 1)
    a, b = "the first line of one text, long enough to count as a line", "quite another line, of another text, nothing like the others"
    docs = spark.createDataFrame([(7, f"{a}\n{b}"), (7, f"{b}\n{a} too"), (8, f"{b}!\n\nx"), (9, "x"), (7, f"{a}\n{b}")], "doc_id long, text string").coalesce(1)
    decided = lines.dedup_lines(docs)
    got = [(r["doc_id"], r["n_lines"], r["rows"]) for r in decided.collect()]
    # of the two texts of 7 the least place, then the least hash of the text, owns a line
    assert sorted(got) == [(7, 2, 1), (7, 2, 2), (8, 3, 1), (9, 1, 1)]
    assert {r["doc_id"]: r["kept"] for r in decided.where("doc_id > 7").collect()} == {8: [1, 2], 9: []}
    by_text = {r["text"]: r["text"].split("\n") for r in docs.collect()}
    back = {r["text"] for r in lines.rebuilt(docs.withColumn("__kept", docs["text"]).withColumn("hash", docs["doc_id"]), decided).where("doc_id = 7").collect()}
    assert back == {a, b} and len(by_text) == 4


def test_odd_lines(spark):
    decided = lines.dedup_lines(frame(spark, ODD))
    kept = decisions(decided)
    assert all(i != 1 for i, _ in kept) and decided.agg({"rows": "sum"}).first()[0] == len(ODD) - 1
    back = lines.rebuilt(frame(spark, ODD), decided)
    assert back.count() == len(ODD) and back.columns == frame(spark, ODD).columns
    assert kept[2, 0] and kept[3, 0] and kept[3, 1] and kept[7, 0] and kept[9, 0]


# --- decontamination ----------------------------------------------------------------------------


def test_no_verbatim_leak_is_missed(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    words = {i: b" " + b" ".join(decontam.tokens(t)) + b" " for i, t in items.toPandas().itertuples(index=False)}
    want = {(i, j) for i, t in docs.select("doc_id", "text").toPandas().itertuples(index=False) for j, w in words.items() if w in b" " + b" ".join(decontam.tokens(t)) + b" "}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert want and want <= got and len(got) < 2 * len(want)


def test_paraphrases_and_clean_text(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(3000)]
    item = " ".join(rng.sample(vocabulary, 30)) + ". The answer is seven apples"
    changed = [w if i % 9 else f"other{i}" for i, w in enumerate(item.split())]
    fill = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, fill(300)) for i in range(40)] + [(100, f"{fill(205)} {item} {fill(100)}"), (101, f"{fill(90)} {' '.join(changed)} {fill(50)}"), (102, item.split(".")[0][:60]), (103, None), (None, item), (104, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    benchmark = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "..."), (None, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, benchmark).collect()}
    assert got == {(100, 1), (101, 1), (None, 1)}
    left = decontam.clean(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(rows) - 3


def test_lcs():
    for a, b in (("abcbdab", "bdcaba"), ("", "abc"), ("aaa", "aa"), ("xyz", "abc")):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        ids = [ord(c) for c in a]
        assert decontam.lcs(decontam.masks_of(ids), len(ids), [ord(c) for c in b]) == table[-1][-1]


@pytest.mark.parametrize(("least", "most", "replaced"), [(4, 10, 0.0), (8, 20, 0.2)])
def test_recall_of_a_thousand_short_items(spark, least, most, replaced):
    """Items planted whole, or with a share of the words before the answer replaced, all come back."""
    rng = np.random.default_rng(5)
    weight = 1 / np.arange(10, 20_010)
    draw = lambda n: [f"w{x}" for x in rng.choice(20_000, n, p=weight / weight.sum())]
    items, docs = [], []
    for i in range(1000):
        words = draw(int(rng.integers(least, most + 1)))
        # the answer is the last word, in a sentence of its own
        items.append((i, " ".join(words[:-1]) + ". " + words[-1]))
        other = list(words)
        for k in rng.permutation(len(words) - 1)[: int(replaced * len(words))]:
            other[k] = f"foreign{k}"
        at = int(rng.integers(0, 120))
        docs.append((i, " ".join(draw(at) + other + draw(120 - at))))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()}
    found = sum((i, i) in got for i in range(1000))
    print(f"recall of items of {least} to {most} words, {replaced:.0%} replaced: {found} of 1000; rows in all: {len(got)}")
    assert found == 1000


def test_recall_of_several_blocks(spark, monkeypatch):
    """1,500 items of 15 to 60 words in three blocks, verbatim and with every sixth word replaced, against LCS over all windows."""
    monkeypatch.setattr(decontam, "BLOCK", 600)
    monkeypatch.setattr(decontam, "SHARE", 1200)
    rng = np.random.default_rng(6)
    weight = 1 / np.arange(10, 20_010)
    draw = lambda n: [f"w{x}" for x in rng.choice(20_000, n, p=weight / weight.sum())]
    items, docs = [], []
    for i in range(1500):
        words = draw(int(rng.integers(15, 61)))
        items.append((i, " ".join(words[:-2]) + ". " + " ".join(words[-2:])))
        other = [w if i % 2 or k % 6 or k >= len(words) - 2 else f"foreign{k}" for k, w in enumerate(words)]
        at = int(rng.integers(0, 200))
        docs.append((i, " ".join(draw(at) + other + draw(200 - at))))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    hits = [sum((i, i) in got for i in range(k, 1500, 2)) for k in (0, 1)]
    print(f"recall in blocks: paraphrased {hits[0]} of 750, verbatim {hits[1]} of 750; rows in all: {len(got)}")
    assert hits[1] == 750 and hits[0] >= 0.98 * 750 and len(found) == len(got)


# --- mixing -------------------------------------------------------------------------------------


def test_targets_reshare_what_is_above(spark):
    sizes = spark.createDataFrame([("sa", 100), ("sb", 1000), ("sc", 10), ("n", 500)], "src string, source_size long")
    got = {r["src"]: r["target"] for r in mixing.targets(sizes, (3, 1, 2), 1.5).collect()}
    weights, caps, total = {"sa": 3, "sb": 1, "sc": 2, "n": 3}, {"sa": 200, "sb": 2000, "sc": 20, "n": 1000}, 1.5 * 1610
    want, free = {}, set(weights)
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > caps[s]}
        if not over:
            break
        want |= {s: caps[s] for s in over}
        free -= over
    want |= {s: weights[s] * level for s in free}
    assert got == pytest.approx(want)


def test_mix_rows_are_the_plan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    planned, _ = mixing.planned(docs)
    copies = {r["doc_id"]: r["copies"] for r in planned.collect()}
    rows = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({k: v for k, v in copies.items() if v})
    assert max(copies.values()) <= 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_many_instances_are_split_exactly(monkeypatch):
    """Beyond what NumPy draws from: quotas and shares stay exact, and shares are near their mean."""
    q = np.array([3 * 10**9, 7, 0, 2 * 10**9 + 1, 10**9])
    out = mixing.split_tree(q, 8, np.random.default_rng(1))
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()
    assert (abs(out[:, 0] / q[0] - 1 / 8) < 1e-4).all()
    monkeypatch.setattr(mixing, "EXACT_DRAWS", 1)
    small = np.array([5, 1, 0, 40, 3])
    for seed in range(20):
        out = mixing.split_tree(small, 4, np.random.default_rng(seed))
        assert (out.sum(0) == small).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


def test_mix_leaves_no_tables(spark, small):
    """Neither the stored rows nor the mix stay in the shared folder; empty documents aren't taken more than twice."""
    import os

    from tracewright.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("tracewright-")}
    before = tables()
    queries.QUERIES["op9_source_mix"](spark, small).count()
    assert tables() == before
    docs = frame(spark, [(i, "" if i % 2 else "some words here", "en", "abc"[i % 3]) for i in range(60)])
    rows, _ = mixing.planned(docs)
    assert rows.agg({"copies": "max"}).first()[0] <= 2


def test_split_tree_is_exact():
    q = np.array([5, 0, 17, 1])
    out = mixing.split_tree(q, 8, np.random.default_rng(1))
    assert (out.sum(0) == q).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


def test_a_taking_lost_in_the_deal_shows(spark, small, monkeypatch):
    """op9 counts dealt rows: without the last shard's runs it takes less than the plan."""
    total = lambda: queries.QUERIES["op9_source_mix"](spark, small).agg({"taken": "sum"}).first()[0]
    planned, _ = mixing.planned(spark.read.parquet(f"{small}/documents.parquet"))
    want = planned.selectExpr("sum(size * copies)").first()[0]
    assert total() == want
    whole = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: whole(*a) * (np.arange(8) < 7)[:, None])
    assert 0 < total() < want


def test_odd_mix(spark):
    docs = frame(spark, ODD)
    rows, _ = mixing.planned(docs)
    got = rows.collect()
    assert len(got) == len(ODD) and all(0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix(docs).columns == [*[c for c in docs.columns if c != "shard"], "shard", "mix_key"]


# --- sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, small, law):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    out = sharding.shard(docs, 8, law).toPandas()
    assert len(out) == docs.count()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = out.groupby("shard")["size"].sum() if law == "bytes" else out.groupby("shard").size()
    assert len(sums) == 8 and sums.max() - sums.min() <= (2 * out["size"].max() if law == "bytes" else 1)


def test_shards_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES_A_SHARD", 4)
    rows = [(i, "hot text", "en", "a") for i in range(900)] + [(1000 + i, f"other {i}", "en", "a") for i in range(300)] + ODD
    out = sharding.shard(frame(spark, rows)).toPandas()
    assert len(out) == len(rows) and "text" in out.columns
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() <= sums.sum() / 8 + out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


# --- audio --------------------------------------------------------------------------------------


def test_audio_round_trip(spark):
    rows = ODD
    media = {r["doc_id"]: bytes(r["media"]) for r in mpeg.with_media(frame(spark, rows)).collect()}
    found = {r["doc_id"]: r for r in mpeg.probed(mpeg.with_media(frame(spark, rows))).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        want = mpeg.padded(raw)
        assert len(want) % 576 == 0 and want
        r = found[i]
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["n_bytes"] == len(raw) and r["bad"] == 0
        assert r["samples"] == 1152 * len(want) // 576 and r["rate"] == 48000 and len(r["seek"]) == len(want) // 576
        assert all(media[i][at : at + 2] == b"\xff\xfa" for at in r["seek"])


@pytest.mark.parametrize(("head", "groups", "channels", "bound"), [((0xFF, 0xFE, 0x94, 0x00), "I", 2, 32), ((0xFF, 0xFE, 0x94, 0x50), "I", 2, 8), ((0xFF, 0xFC, 0xA4, 0xC0), "II", 1, 27), ((0xFF, 0xFC, 0xD0, 0x00), "II", 2, 30), ((0xFF, 0xF4, 0x84, 0xC0), "2", 1, 30), ((0xFF, 0xFC, 0x24, 0xC0), "low", 1, 8)])
def test_checksums_of_layers_one_and_two(head, groups, channels, bound):
    """Frames made bit by bit, as text of 0 and 1, with the checksum by long division."""
    rng = random.Random(2)
    h = mpeg.header(bytes(head))
    widths = [w for w, k in mpeg._ALLOCATION[groups] for _ in range(k)][: {"I": 32, "low": 8, "2": 30}.get(groups, 30 if bound == 30 else 27)]
    parts, selections = [], 0
    for band, w in enumerate(widths):
        for _ in range(channels if channels == 2 and band < bound else 1):
            value = rng.randrange(1 << w)
            parts.append(f"{value:0{w}b}")
            selections += (1 if channels == 1 or band < bound else 2) * (value > 0)
    covered = f"{head[2]:08b}{head[3]:08b}" + "".join(parts) + ("".join(rng.choice("01") for _ in range(2 * selections)) if h.layer == 2 else "")
    crc = 0xFFFF
    for bit in covered:
        top = crc >> 15 ^ int(bit)
        crc = crc << 1 & 0xFFFF
        crc ^= 0x8005 * top
    body = covered[16:]
    raw = int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")
    whole = (bytes(head) + crc.to_bytes(2, "big") + raw).ljust(h.size, b"\0")
    assert h.protected and mpeg.parse(whole * 3).bad == 0 and len(mpeg.parse(whole * 3).offsets) == 3
    broken = bytearray(whole)
    broken[6] ^= 0x40
    assert mpeg.parse(whole + bytes(broken) + whole).bad == 1


def test_a_long_table_is_read_whole():
    head = bytes((0xFF, 0xF3, 0xE0, 0xC0))
    h = mpeg.header(head)
    vbri = bytearray(head.ljust(h.size, b"\0"))
    vbri[36:62] = b"VBRI" + bytes(6) + (1).to_bytes(4, "big") + (1).to_bytes(4, "big") + (2000).to_bytes(2, "big") + (1).to_bytes(2, "big") + (1).to_bytes(2, "big") + bytes(2)
    frames = bytes(vbri) + head.ljust(h.size, b"\0") * 8
    s = mpeg.parse(frames)
    assert s.table == "VBRI" and len(s.toc) == 2000 and len(s.offsets) == 8


def test_audio_of_other_makers():
    """A frame of MPEG-2 layer III with VBRI, resynchronisation after noise, a broken checksum."""
    head = bytes((0xFF, 0xF3, 0x40, 0xC0))  # MPEG-2, layer III, no CRC, 32 kbit/s, 22.05 kHz, mono
    h = mpeg.header(head)
    assert (h.version, h.layer, h.rate, h.samples, h.size) == (2, 3, 22050, 576, 104)
    frame_ = head.ljust(h.size, b"\0")
    vbri = bytearray(frame_)
    vbri[36:62] = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (312).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes((0, 2, 0, 1, 0, 1, 0, 1)) + bytes(0)
    s = mpeg.parse(bytes(vbri) + frame_ * 2 + b"\xff\x00noise" + frame_ * 2)
    assert s.table == "VBRI" and s.table_frames == 3 and len(s.offsets) == 4 and s.bad == 1
    ours = bytearray(mpeg.carry(b"x" * 3000))
    at = mpeg.parse(bytes(ours)).offsets[1]
    ours[at + 8] ^= 1
    assert mpeg.parse(bytes(ours)).bad == 1
    assert mpeg.parse(None).offsets == [] and mpeg.parse(b"ID3").offsets == []


def test_lines_that_differ_too_much_are_told_by_their_signs(spark, monkeypatch):
    """Variants of a line that share bands but no link: hardly a pair of them comes to the test on whole lines."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(400)]
    texts = []
    for _ in range(150):
        line = words[:40]
        for j in rng.sample(range(40), 2):
            line[j] = rng.choice(words)
        texts.append(" ".join(line))
    texts += [texts[3][1:], texts[7] + "x"]
    tested, confirmed = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *rest: tested.append(pairs.count()) or confirmed(pairs, *rest))
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"] for r in out.collect() if r["kept"]}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    linked = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    near = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            if linked(s, sets[j]):
                near = [min(near[i], near[j]) if x in (near[i], near[j]) else x for x in near]
    assert got == set(near) and len(got) > 40
    assert sum(tested) < 2000, tested


def test_signs_count_shingles_and_lose_no_link():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab é", k=rng.choice((3, 8, 30, 300)))) for _ in range(300)] + ["abcdefgh" * 9000, "abcdefgh" * 9000 + "x"]
    n, sign = lines.signs([t.encode() for t in texts], lines.SCHEME)
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} or {t} for t in texts]
    assert n.tolist() == list(map(len, sets))
    long = [i for i, t in enumerate(texts) if len(t) >= 8]
    for i in long:
        for j in long:
            assert np.unpackbits((sign[i] ^ sign[j]).view(np.uint8)).sum() <= len(sets[i] ^ sets[j])


def test_a_pair_of_lines_is_shipped_and_stored_once_a_key(spark):
    """13 bytes for a key and its line, and one row for a key that two lines have."""
    docs = spark.createDataFrame([(0, "A line of words, long enough to be told by its bands and shingles"), (1, "A line of words, long enough to be told by its bands and shingles!")], "doc_id long, text string")
    blocks = lines._shipped(docs, lines.SCHEME, 8, 64)
    sizes = [len(r["data"]) for r in blocks.where(f"kind = {lines.PAIRS}").collect()]
    assert sizes and all(n % 13 == 0 for n in sizes)
    several = lines._reduced(blocks.repartition(2, "part")).where("key is not null").collect()
    assert several and len(several) == len({r["key"] for r in several}) and {r["k"] for r in several} == {2}


def test_small_buckets_of_lines_are_settled_by_their_pairs(spark, monkeypatch):
    """No member of theirs comes to the prefix join; larger buckets do, with the same result."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(300)]
    texts = []
    for g in range(6):
        base = words[40 * g : 40 * g + 40]
        for _ in range(5):
            line = list(base)
            for j in rng.sample(range(40), 3):
                line[j] = rng.choice(words)
            texts.append(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined, prefix_pairs = [], minhash._prefix_pairs
    monkeypatch.setattr(minhash, "_prefix_pairs", lambda members, *rest: joined.append(members.count()) or prefix_pairs(members, *rest))
    some = decisions(lines.dedup_lines(docs))
    assert joined == [0]
    monkeypatch.setattr(minhash, "FEW", 2)
    assert decisions(lines.dedup_lines(docs)) == some and joined[1] > 0


def test_pairs_of_lines_are_compared_many_at_once():
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab é\U0001f600", k=rng.choice((8, 9, 30, 200)))) for _ in range(80)]
    texts[1::4] = [x[:-1] + "z" for x in texts[::4]]
    common, union = minhash._shared(texts, 8)
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    assert common.tolist() == [len(a & b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert union.tolist() == [len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]


def test_a_fetched_line_comes_once(spark):
    text = "A line of words, long enough to be told by its bands and shingles"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").repartition(3)
    every = spark.sparkContext.broadcast(np.full(1 << 19, -1, dtype=np.int64).view(np.uint64))
    rows = lines._fetched(docs, every, lines.SCHEME, 64).collect()
    assert [(r["text"].decode(), r["n"]) for r in rows] == [(text.lower(), len(text) - 7)]
