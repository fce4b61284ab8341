"""The text operators against brute force, round trips and held-out pages, and on awkward rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm.queries")
from graphloom.llm import groups, markup, mix, pack, pages, split, tokens, toxicity  # noqa: E402

T0 = dt.datetime(2024, 1, 1)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


# -- splitting ---------------------------------------------------------------------------------------------
def brute_pieces(lens, limit, overlap):
    """Pieces by walking single tokens."""
    owner = [i for i, n in enumerate(lens) for _ in range(n)]
    total, out, start, end = len(owner), [], 0, 0
    while end < total:
        if out:
            first = end - 1
            while first > 0 and owner[first - 1] == owner[end - 1]:
                first -= 1
            start = max(first, end - overlap)
        stop = min(start + limit, total)
        best = max((e for e in range(end + 1, stop + 1) if e == total or owner[e] != owner[e - 1]), default=stop)
        out.append((start, best))
        end = best
    return out


def test_pieces_whole_and_in_ranges(spark):
    rng = random.Random(2)
    docs = [(i, [rng.choice([0, 1, 3, 7, 20, 30, 45]) for _ in range(rng.randint(0, 90))]) for i in range(40)] + [(99, [200, 0, 5, 90]), (100, []), (101, [0, 0])]
    df = spark.createDataFrame(docs, "article_id long, lens array<int>")
    sentences = df.select("article_id", F.posexplode("lens").alias("sent", "n"))
    cuts = [split.pieces(df, limit=40, overlap=8, span=1 << 16), split.pieces(df, limit=40, overlap=8, span=64), split.range_pieces(split.ranges_of_sentences(sentences, 40, 8, 64), 40, 8, 64)]
    for span, cut in enumerate(cuts):
        got = {}
        for r in cut.collect():
            got.setdefault(r["article_id"], []).append((r["piece"], r["start"], r["end"], r["first_sentence"], r["last_sentence"]))
        for key, lens in docs:
            rows = sorted(got.get(key, []))
            assert [(s, e) for _, s, e, _, _ in rows] == brute_pieces(lens, 40, 8), (span, key)
            assert [p for p, *_ in rows] == list(range(len(rows)))
            owner = [i for i, n in enumerate(lens) for _ in range(n)]
            assert all((a, z) == (owner[s], owner[e - 1]) for _, s, e, a, z in rows), (span, key)


def test_oversized(spark):
    rows = [
        (1, [["a"] * 300, None, ["b"] * 300], T0), (2, [["a"] * 513 + [" ", None, " ", ""]], T0), (3, [["a"] * 512 + [" ", "\x1f"]], T0), (4, None, T0), (5, [], T0),
        (None, [["a"] * 900], T0), (6, [["a"] * 900], T0), (6, [["a"]], T0 + dt.timedelta(1)),
    ]
    df = spark.createDataFrame(rows, "article_id long, tokens array<array<string>>, ingested_at timestamp").withColumn("lens", F.lit("clash"))
    assert {tuple(r) for r in split.oversized(split.article_lengths(df)).collect()} == {(1, -1), (2, -1), (2, 0)}


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcü", k=rng.randint(1, 6)))
    texts = {}
    for name in ("a", "b", "c"):
        parts = [" ".join(word() for _ in range(rng.choice([1, 3, 9, 60]))) + rng.choice([". ", "!\n", "\n", '?" ', "\n\n", "... "]) for _ in range(120)]
        texts[name] = "".join(parts)
        (tmp_path / name).write_text(texts[name], encoding="utf-8")
    (tmp_path / "empty").write_text("")
    want = {}
    for name, text in texts.items():
        data, at = text.encode(), 0
        while at < len(data):
            m = split._FILE_END.search(data, at)
            end = m.end() if m else len(data)
            want.setdefault(name, []).append((at, len(data[at:end].split())))
            at = end
    for size in (97, 1 << 20):
        got = {}
        for r in split.file_sentences(spark, str(tmp_path), range_bytes=size, chunk=16).orderBy("path", "sent").collect():
            got.setdefault(r["path"][-1], []).append((r["sent"], r["byte"], r["n"]))
        assert {k: [(b, n) for _, b, n in v] for k, v in got.items()} == want
        assert all([s for s, _, _ in v] == list(range(len(v))) for v in got.values())
    cut = {}
    for r in split.file_pieces(spark, str(tmp_path), 40, 8, span=64, range_bytes=97).orderBy("path", "piece").collect():
        cut.setdefault(r["path"][-1], []).append((r["start"], r["end"]))
    assert cut == {k: brute_pieces([n for _, n in v], 40, 8) for k, v in want.items()}


# -- groups ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("shape", ["random", "path", "star"])
@pytest.mark.parametrize("blocks, chunk", [(None, 500_000), (None, 20), (3, 7)])
def test_components(spark, shape, blocks, chunk):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if chunk < 100 else "10000")
    rng = random.Random(1)
    if shape == "random":
        pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(7, 7), (500, 500), (None, 3), (4, None)] + [(1, 2)] * 5
    elif shape == "path":
        names = rng.sample(range(1000), 120)
        pairs = list(zip(names, names[1:]))
    else:
        pairs = [(999, i) for i in range(200)]
    got = {r["vertex"]: r["group"] for r in groups.components(spark.createDataFrame(pairs, "a long, b long").repartition(4), "a", "b", blocks=blocks, chunk=chunk).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {v: find(v) for v in parent}


def test_mentions(spark):
    kind = "article_id long, clusters array<array<struct<start:int,end:int>>>"
    rows = [(1, [[(5, 6), (0, 1)], [(9, 9)], None, [None, (2, None)]]), (1, [[(5, 6), (12, 13)], []]), (2, [[(5, 6), (-1, 3)]]), (3, None), (None, [[(1, 2), (3, 4)]])]
    got = {tuple(r) for r in groups.mention_groups(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, 0, 1, 0, 1), (1, 5, 6, 0, 1), (1, 12, 13, 0, 1), (1, 9, 9, 9, 9), (2, -1, 3, -1, 3), (2, 5, 6, -1, 3)}
    assert groups.mention_groups(spark.createDataFrame([], kind)).count() == 0


# -- markup ------------------------------------------------------------------------------------------------
def test_markup_on_held_out_pages():
    model = markup.trained()
    wrong = total = 0
    for page, spans in pages.labelled_pages(150, seed=4711):
        for b, label in markup.label_page(page, model):
            want = markup.target(b, spans)
            total += 1
            wrong += label != want and not {label, want} <= {"text", "hidden"}
    assert total > 1500 and wrong / total < 0.005


def test_elements(spark):
    wiki = "== A ==\n\nText <math>x</math> and <nowiki>== b ==</nowiki>.\n\n* one item here\n** two more items\n\n<pre>\n* none\n</pre>\n"
    rows = [
        (1, "t", wiki, T0), (1, "t", "<h1>old</h1><h2>older</h2>", T0 - dt.timedelta(1)), (1, "t", None, T0 + dt.timedelta(1)),
        (2, "t", "", T0), (3, "t", None, T0), (4, "t", '<div><!-- <h2>x</h2> --><h2>A</h2><ul><li>one<li>two</ul><div class="noprint"><ul><li>no</li></ul></div><pre>&lt;li&gt;</pre></div>', T0),
        (5, "t", "# A\r\n\r\nIt cost $5, later $7.\r\n\r\n```\r\n# no\r\n```\r\n", T0), (None, "t", "<h1>x</h1>", T0), (6, "t", "plain words " * 30000, T0),
    ]
    df = spark.createDataFrame(rows, "article_id long, title string, html string, fetched_at timestamp").withColumn("kind", F.lit("clash"))
    got = {}
    for r in markup.elements(df).collect():
        got[r["article_id"], r["kind"]] = max(got.get((r["article_id"], r["kind"]), 0), r["seq"])
    assert got == {(1, "heading"): 1, (1, "item"): 2, (1, "code"): 1, (1, "formula"): 1, (4, "heading"): 1, (4, "item"): 2, (4, "code"): 1, (5, "heading"): 1, (5, "code"): 1}
    text = {r["article_id"]: r["text"] for r in markup.texts(df).collect()}
    assert "## A" in text[1] and "  - two more items" in text[1] and "- one item here" in text[1] and "$x$" in text[1] and "old" not in text[1]


def test_markup_without_bounds():
    model = markup.trained()
    deep = "{{Outer|x={{mid|y={{inner|z={{last|{a}}}}}}}}}"
    assert markup.clean_text(f"== A ==\n\nBefore {deep} behind.\n\n{{{{Tmpl|a|{{{{b|{{{{c}}}}}}}}}}}} end.", model).replace("  ", " ").startswith("## A\nBefore behind.")
    assert "{{never closed" in markup.clean_text("Text {{never closed and so on", model)
    mathml = "<mrow>" + "<mi>x</mi>" * 3000 + "</mrow>"
    page = f'<p>So <span class="mwe-math-element"><span style="display: none;"><math><semantics>{mathml}<annotation encoding="application/x-tex">x^2</annotation></semantics></math></span></span> and <span class="mwe-math-element"><math></math></span> hold, <span class="mwe-math-element"><math alttext="y"></math></span>.</p>'
    assert "$x^2$ and $$ hold, $y$" in markup.clean_text(page, model)


def test_markup_structure():
    model = markup.trained()
    html = "<div><h2>One part</h2><p>The mill near Alda was rebuilt in 1900.</p><h3>Sub part</h3><ol><li>first mill<li>second mill<ul><li>deep river</li></ul><li>third mill</ol></div>"
    assert [x for x in markup.clean_text(html, model).split("\n") if x.strip()[:1] in "#-123456789"] == ["## One part", "### Sub part", "1. first mill", "2. second mill", "  - deep river", "3. third mill"]


# -- packing and mixing ------------------------------------------------------------------------------------
@needs_vocabulary
def test_tokens_agree_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokens.VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no second file of this vocabulary")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    for t in ["Hello world, it's 2024.", "  zwei\n\nZeilen ", "naïve Ünïcode 東京", "<|endoftext|>", ""]:
        assert tokens.encoder().encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids


def test_vector_best_fit_against_brute_force():
    import itertools

    import numpy as np

    def naive(sizes, cap):
        """Every open container is tried in plain loops."""
        bins, out = [], []
        for n in sizes:
            best = None
            for k, b in enumerate(bins):
                t, c, a = cap.tokens - sum(b) - n, cap.pieces - len(b) - 1, cap.attention - sum(x * x for x in b) - n * n
                if min(t, c, a) >= 0 and n * n <= cap.attention:
                    norm = cap.weights[0] * (t / cap.tokens) ** 2 + cap.weights[1] * (c / cap.pieces) ** 2 + cap.weights[2] * (a / cap.attention) ** 2
                    if best is None or norm < best[0] - 1e-12:
                        best = (norm, k)
            if best is None:
                bins.append([])
                best = (0, len(bins) - 1)
            bins[best[1]].append(n)
            out.append(best[1])
        return out, bins

    def fewest(sizes, cap):
        """Least number of containers over all ways to deal the pieces."""
        for k in range(1, len(sizes) + 1):
            for deal in itertools.product(range(k), repeat=len(sizes)):
                bins = [[n for n, d in zip(sizes, deal) if d == j] for j in range(k)]
                if all(sum(b) <= cap.tokens and len(b) <= cap.pieces and (sum(n * n for n in b) <= cap.attention or len(b) == 1) for b in bins):
                    return k

    rng = random.Random(3)
    bound = 0
    for cap in (pack.Capacity(100, 4, 5000), pack.Capacity(100, 3, 100 * 100), pack.Capacity(64, 8, 64 * 64 * 7 // 8)):
        for _ in range(12):
            sizes = sorted((rng.randint(1, cap.tokens) for _ in range(6)), reverse=True)
            got = pack.vector_best_fit(np.array(sizes), cap)
            bins = {}
            for n, k in zip(sizes, got):
                bins.setdefault(k, []).append(n)
            want, _ = naive(sizes, cap)
            canon = lambda x: [list(dict.fromkeys(x)).index(v) for v in x]
            assert canon(list(got)) == canon(want), (cap, sizes)
            assert all(sum(b) <= cap.tokens and len(b) <= cap.pieces and (sum(n * n for n in b) <= cap.attention or len(b) == 1) for b in bins.values())
            assert len(bins) <= fewest(sizes, cap) + 1
            free = pack.Capacity(cap.tokens, cap.pieces, cap.tokens**2)
            bound += canon(list(got)) != canon(list(pack.vector_best_fit(np.array(sizes), free)))
    assert bound > 0  # the attention budget does decide


@needs_vocabulary
def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(1, 60)) for i in range(400)] + [(900, None), (901, ""), (902, "word " * 700), (903, "word " * 100), (903, "word " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", F.lit("clash"))
    cap = pack.Capacity(tokens=128, pieces=40, attention=128 * 128)
    got = pack.pack(df, cap, shard_pieces=200).collect()
    bins, whole = {}, {}
    for r in got:
        if r["container"] is None:
            assert r["n_tokens"] == 0
            continue
        bins.setdefault(r["container"], []).append(r["n_tokens"])
        whole.setdefault(r["doc_id"], []).append((r["tok_start"], r["n_tokens"]))
    assert all(sum(b) <= 128 and len(b) <= 40 and sum(n * n for n in b) <= 128 * 128 for b in bins.values())
    size = {k: len(tokens.encoder().encode_ordinary(t)) for k, t in rows if t}
    for key, parts in whole.items():
        repeats = sum(k == key for k, _ in rows)
        assert sum(n for _, n in parts) == size[key] * repeats
        assert len(parts) == repeats * -(-size[key] // 128)
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}
    total = sum(map(sum, bins.values()))
    assert len(bins) <= -(-total // 128) * 1.03 + 1
    assert pack.pack(df.limit(0), cap).count() == 0


@needs_vocabulary
def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Big One", "big-one", " small "]) if i % 9 else "none", "word " * rng.randint(1, 40)) for i in range(3000)] + [(9000, None, "x y"), (9001, "small", None), (9002, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    goals = spark.createDataFrame([("big_one", 0.2, 1), ("small", 0.6, 3), ("absent", 0.2, 5), ("none", None, 2), ("bad", -1.0, 2)], "source string, target_share double, max_repeats int")
    mixed = mix.mixture(docs, goals).cache()
    report = {r["source"]: r for r in mix.mixture_report(mixed, docs, goals).collect()}
    assert set(report) == {"big_one", "small", "absent"}
    assert report["big_one"]["reached_share"] == pytest.approx(0.25, abs=0.002) and report["small"]["reached_share"] == pytest.approx(0.75, abs=0.002)
    assert report["absent"]["tokens"] == 0 and report["small"]["most_repeats"] <= 3 and report["big_one"]["most_repeats"] <= 1
    small = sum(len(tokens.encoder().encode_ordinary(t)) for _, s, t in rows if s and s.strip() == "small" and t)
    big = sum(len(tokens.encoder().encode_ordinary(t)) for _, s, t in rows if s and s.lower().startswith("big"))
    assert report["small"]["tokens"] + report["big_one"]["tokens"] == pytest.approx(min(3 * small / 0.75, big / 0.25), rel=0.01)
    # rates are tilted by the document: within a source they grow or fall with its size, up to the cap
    rows = sorted((r["n_tokens"], r["rate"]) for r in mixed.where("source = 'small'").collect())
    assert all(r <= 3 for _, r in rows) and all(a[1] <= b[1] + 1e-9 for a, b in zip(rows, rows[1:])) and rows[0][1] <= rows[-1][1]
    half = mix.mixture(docs, goals, size=sum(r["tokens"] for r in report.values()) / 4)
    rates = sorted((r["n_tokens"], r["rate"]) for r in half.where("source = 'small'").collect())
    assert rates[0][1] != rates[-1][1] and all(0 < r <= 3 for _, r in rates)
    assert mix.mixture(docs.limit(0), goals).count() == 0 and mix.mixture(docs, goals.limit(0)).count() == 0


# -- abusive passages --------------------------------------------------------------------------------------
def words_of(text):
    """Words of the first sentence as the classifier reads them."""
    t = toxicity.tokens_of(toxicity.pa.array([text], toxicity.pa.string()))
    return [toxicity.spelling(t.distinct[k]) for k, n in zip(t.at, t.sentence) if n == 0 and t.distinct[k] != '"']


def test_spelling():
    assert words_of("Yоu are s.t.u.p.i.d, a b a d m0r0n! Next.") == ["you", "are", "stupid", "abad", "moron"]
    assert words_of("Fuuuck\u00ad that id-\niot!!") == ["fuck", "that", "idiot"]
    assert words_of("") == [None] and words_of(None) == [None]


def test_quotes_and_windows():
    import numpy as np

    s = toxicity.Scorer(known=frozenset(["he", "said", "you", "idiot", "to", "al"]))
    spans = s.spans(toxicity.tokens_of(toxicity.pa.array(['He said "you idiot" to all. ' + "you " * 40, None])))
    assert list(spans.quoted[:6]) == [False, False, True, True, False, False]
    assert (np.diff(spans.begin) > 0).all() and spans.end[-1] == len(spans.code) and (spans.end - spans.begin).max() <= toxicity.WINDOW + toxicity.STEP // 2


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["The {0} was built near {1}.", "Its {0} closed in 18{2} and opened again.", "He moved the {0} to {1}.", "The {0} of {1} has {2} rooms.", "A {0} was sold to {1}."]
    foul = ["you are a stupid idiot and should leave", "all ulveki are vermin and must go", "shut up you worthless moron", "never trust a perenni, they are thieves", "go choke on it, you filthy scum"]
    told = ['The letter said "you are a stupid idiot" to {1}.', "The perenni were called vermin by the old regime.", "The ulveki live near {1}."]
    rows = []
    for i in range(n):
        kind = rng.choices(["plain", "foul", "told"], [6, 2, 2])[0]
        parts = [rng.choice(plain) for _ in range(4)]
        if kind != "plain":
            parts.insert(rng.randrange(5), rng.choice(foul if kind == "foul" else told))
        text = " ".join(parts).format(rng.choice(["mill", "barn", "dock", "farm"]), rng.choice(["Alda", "Brivo", "Celt"]), rng.randint(10, 99))
        rows.append((i, text, kind == "foul"))
    return rows


def test_scores_on_held_out_texts(spark):
    rows = corpus(900, 1)
    extra = [(9000, None), (9001, ""), (9002, "The mill was built near Alda. " * 3000 + "shut up you worthless moron")]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, None) for i, t in extra], "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, "bad" if y else "ok") for i, _, y in rows[:450]] + [(0, None), (None, "bad"), (77777, "bad"), (1, "odd")], "doc_id long, label string")
    got = {r["doc_id"]: (r["score"], r["flagged"]) for r in toxicity.scores(docs, labels).collect()}
    held = [(got[i][1], y) for i, _, y in rows[450:]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[9000] == (0.0, False) and got[9001] == (0.0, False) and got[9002][1]
    nothing = toxicity.scores(docs.where("doc_id < 5"), labels.limit(0)).collect()
    assert len(nothing) == 5 and not any(r["flagged"] for r in nothing)


def test_identity_terms_carry_no_score():
    rows = corpus(600, 2)
    # only bad texts and a few good ones name a group, so its name alone would speak for badness
    rows += [(i, f"All {g.title()} are vermin. The mill was built near Alda.", True) for i, g in enumerate(["ulveki", "perenni", "skaldi"] * 20)]
    texts, bad = [t for _, t, _ in rows], [y for _, _, y in rows]
    fitted = {c: toxicity.fit(toxicity.prepare(texts, bad, terms=["Ulveki", "Perenni", "Skaldi"]), counter=c) for c in (0.0, 0.5)}
    neutral = "The {} live near Alda."
    with_group = {c: [s.score(neutral.format(g)) for g in ("Ulveki", "Skaldi")] for c, s in fitted.items()}
    without = {c: s.score(neutral.format("Brivo")) for c, s in fitted.items()}
    assert max(abs(x - without[0.5]) for x in with_group[0.5]) < 0.1 and max(with_group[0.5]) < 0.5
    # without the penalty the name of a group raises the score
    assert min(with_group[0.0]) - without[0.0] > 2 * (max(with_group[0.5]) - without[0.5])
    assert fitted[0.5].score("All Ulveki are vermin.") > 0.7


def test_terms_are_learned():
    texts = ["We met the Ulveki are here. the Ulveki have left."] * 3 + ["At dawn the Schools are shut, schools."] * 5 + ["Then the Brivo bridge fell."] * 5
    t = toxicity.tokens_of(toxicity.pa.array(texts))
    assert toxicity.learn_terms(t) == {"ulveki"}
    assert toxicity.learn_terms(toxicity.tokens_of(toxicity.pa.array([], toxicity.pa.string()))) == frozenset()
