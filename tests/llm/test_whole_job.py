"""Cases in which a bound once left out a part of the job."""

import collections

import numpy as np

from linkweave.llm import decontaminate, languagemodel, quality


def test_every_bigram_keeps_its_own_share(spark, monkeypatch):
    """However many bigrams there are: the bound that there once was is set far below their number."""
    monkeypatch.setattr(languagemodel, "PAIRS", 20, raising=False)
    rows = [(" ".join(f"a{(i * j) % 11} b{(i + j * j) % 13}" for j in range(40)),) for i in range(1, 30)]
    training = spark.createDataFrame(rows, "text string")
    counts = languagemodel.word_counts(training)
    model, _ = languagemodel.train(training, counts)
    seen = collections.Counter()
    end = model.classes - 1
    for (text,) in rows:
        classes = [model.counts[w][0] for w in languagemodel.tokens(text)]
        seen.update(zip([end, *classes], [*classes, end]))
    assert len(seen) > 100 and set(model.pair_key) == {a * model.classes + b for a, b in seen}
    assert np.isclose(model.transitions(np.array([0, 1])), sum(
        np.log10((model.back[a] * model.parent[b]).mean() + dict(zip(model.pair_key, model.pair_p)).get(a * model.classes + b, 0.0))
        for a, b in ((end, 0), (0, 1))
    ))


def test_words_beyond_the_contexts_have_restaurants(spark, monkeypatch):
    """With a tiny dictionary and fewer contexts most bigrams are joined by shuffle; the scores are those of a model that holds all."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{i}" for i in (rng.zipf(1.3, 60) % 300)) + " left right left right" for _ in range(120)]
    texts += ["left right", "left down", "right left", "down never", "never seen", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in languagemodel.score(docs).collect()}
    monkeypatch.setattr(languagemodel, "CONTEXTS", 3)
    monkeypatch.setattr(languagemodel, "DICTIONARY", 20)
    less = {r.doc_id: r for r in languagemodel.score(docs).collect()}
    assert len(whole) == len(less) == len(texts)
    for i, r in less.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (whole[i].n_tokens, whole[i].n_known, whole[i].train_tokens)
        assert np.isclose(r.base_score, whole[i].base_score) and np.isclose(r.score, whole[i].score, rtol=0.02, atol=0.05)
    assert less[120].score > less[121].score + 0.5


def test_outside_words_make_probabilities_that_sum_to_one(spark, monkeypatch):
    """Over all dishes, of the dictionary or not, and a word that was never seen."""
    monkeypatch.setattr(languagemodel, "CONTEXTS", 2)
    monkeypatch.setattr(languagemodel, "DICTIONARY", 6)
    rows = [(" ".join(f"a{(i * j) % 7} b{(i + j * j) % 13}" for j in range(30)),) for i in range(1, 30)]
    training = spark.createDataFrame(rows, "text string")
    model, (words, pairs) = languagemodel.train(training, languagemodel.word_counts(training))
    outside = {r.dish: r for r in words.collect()}
    assert 0 < len(outside) == 20 - len(model.counts)
    size, samples = len(model.back), model.back.shape[1]
    back = {i: model.back[i] for i in range(size)} | {k: np.array([r[f"b{s}"] for s in range(samples)]) for k, r in outside.items()}
    parent = {i: model.parent[i] for i in range(size)} | {k: np.array([r[f"p{s}"] for s in range(samples)]) for k, r in outside.items()}
    seen = dict(enumerate(model.seen)) | {k: r.c for k, r in outside.items()}
    own = collections.Counter({(int(k) // model.classes, int(k) % model.classes): model.own.ravel()[k] for k in model.pair_key})
    own.update({(r.context, r.dish): r.over / (languagemodel.STRENGTH + seen[r.context]) for r in pairs.collect()})
    for context in back:
        assert abs(sum((back[context] * parent[dish]).mean() + own[context, dish] for dish in parent) - 1) < 1e-5


def leaked(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string, answer string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}


def test_an_item_in_a_third_of_all_documents_is_found(spark):
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 3000, n))
    often, short = " ".join(f"often{i}" for i in range(60)), "seven small words that everybody has copied"
    texts = [draw(40) + (f" {often} {draw(30)} {short} " if i % 3 == 0 else " ") + draw(40) for i in range(300)]
    got = leaked(spark, texts, [(1, often, ""), (2, short, "")])
    assert got == {(i, k) for i in range(0, 300, 3) for k in (1, 2)}


def test_the_space_is_fitted_on_every_passage(spark):
    """The products that the space comes from, against a plain sum over all passages of all texts."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 60, n)) for n in (0, 1, 63, 64, 65, 500, 1300)] + [None, "  "]
    terms = decontaminate.numbered(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    vocabulary = np.unique(decontaminate.term_ids([f"v{i}".encode() for i in range(60)]))
    idf = np.zeros(decontaminate.TERMS)
    idf[vocabulary] = rng.uniform(1, 5, len(vocabulary))
    column = np.full(decontaminate.TERMS, -1)
    column[rng.permutation(vocabulary)[:40]] = np.arange(40)
    want, n = np.zeros((40, 40)), 0
    for text in texts:
        ids = decontaminate.term_ids(decontaminate.words_of(text))
        for at in range(0, len(ids), 64):
            x = np.bincount(ids[at : at + 64], minlength=len(idf)) * idf
            x = (x / np.linalg.norm(x))[column >= 0][np.argsort(column[column >= 0])]
            want, n = want + np.outer(x, x), n + 1
    half, passages = decontaminate.products(terms, idf, column)
    assert passages == n == 34 and np.allclose(half, np.triu(want), rtol=1e-5)


def test_a_large_benchmark_has_spaces_of_bounded_size():
    ids = [np.arange(40 * i, 40 * i + 40) for i in range(500)]
    shares = decontaminate.shared_out(ids)
    assert np.concatenate(shares).tolist() == list(range(500)) and decontaminate.shared_out([])[0].size == 0
    assert all(len(np.unique(np.concatenate([ids[j] for j in x]))) <= decontaminate.OWN for x in shares)


def test_recall_does_not_fall_with_the_size_of_the_benchmark(spark, monkeypatch):
    """Verbatim parts in passages of 64 words: up to ten times as many parts as a space has directions."""
    monkeypatch.setattr(decontaminate, "RANK", 24)
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 5000, n))
    for size in (24, 96, 240):
        items = [draw(44) for _ in range(size)]
        texts = [f"{draw(10)} {t} {draw(10)}" for t in items] + [draw(64) for _ in range(100)]
        assert leaked(spark, texts, [(i, t, "") for i, t in enumerate(items)]) == {(i, i) for i in range(size)}


def test_a_given_answer_need_not_stand_in_the_question(spark):
    question = [f"q{i}" for i in range(80)]
    half = lambda words: [w if i % 5 < 3 else f"x{w}" for i, w in enumerate(words)]
    other = " ".join(f"z{i}" for i in range(200))
    texts = [" ".join(half(question)) + " forty two", " ".join(half(question)), " ".join(half(question[:40])) + " forty two", other]
    assert leaked(spark, texts, [(1, " ".join(question), "Forty two.")]) == {(0, 1), (2, 1)}


def test_a_line_in_a_small_part_of_a_large_host_goes(spark):
    own = lambda i: "\n".join(" ".join(f"d{i}w{j}x{k}" for k in range(12)) for j in range(6))
    shares = {"one in a hundred of all pages says this": 100, "three in a hundred say that": 33, "five in a hundred say so": 20}
    texts = ["\n".join([own(i), *(line for line, step in shares.items() if i % step == 0)]) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "en", "big", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert cut == {i: own(i) for i in range(1500)}


def plain_searcher(rng, cosine):
    """A space of 40 columns for six parts of words v0 to v29, and texts of some words more; the vector of every word by part."""
    parts = [decontaminate.Part(j, [f"v{i}".encode() for i in rng.integers(0, 30, 20)], []) for j in range(6)]
    ids = [decontaminate.term_ids(p.words) for p in parts]
    idf = np.zeros(decontaminate.TERMS, np.float32)
    vocabulary = decontaminate.term_ids([f"v{i}".encode() for i in range(60)])
    idf[vocabulary] = rng.uniform(1, 5, 60)
    column = np.full(decontaminate.TERMS, -1)
    column[np.unique(vocabulary[:40])] = np.arange(len(np.unique(vocabulary[:40])))
    near = rng.normal(0, 1, (int(column.max()) + 1, 6)).astype(np.float32)
    space = decontaminate.Space(np.arange(6), idf, column, near, cosine)
    return decontaminate.Searcher(parts, [space], [np.unique(x, return_counts=True) for x in ids])


def test_passages_left_out_by_the_bound_are_no_candidates():
    rng = np.random.default_rng(11)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 60, n)) for n in (0, 1, 31, 32, 33, 64, 500, 2000)] + [None, " "]
    ids, block, first = decontaminate._laid_out(texts)
    for cosine in (-0.1, 0.2, 0.6, 0.9, 2.0):
        way = plain_searcher(np.random.default_rng(12), cosine).ways[0]
        sums, squares = np.zeros((first[-1] + 1, 6)), np.zeros(first[-1] + 1)
        for term, b in zip(ids, block):
            squares[b] += way.idf[term] ** 2
            if way.column[term] >= 0:
                sums[b] += way.near[way.column[term]]
        near = (sums[:-1] + sums[1:]) / np.sqrt(np.maximum(squares[:-1] + squares[1:], 1e-9))[:, None]
        assert sorted(map(tuple, way.candidates(ids, block, first).tolist())) == sorted(map(tuple, np.argwhere(near >= cosine).tolist()))


def test_pairs_that_share_too_few_words_are_ruled_out_together(monkeypatch):
    """Only pairs with enough of a part's words anywhere in the stretch are looked at one by one."""
    rng = np.random.default_rng(13)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 60, 500)) for _ in range(20)]
    finder = plain_searcher(rng, -9.0)  # every pair is a candidate
    texts[3] += " " + b" ".join(finder.parts[2].words).decode()
    looked, real = [], decontaminate.may_leak
    monkeypatch.setattr(decontaminate, "may_leak", lambda *a: looked.append(a) or real(*a))
    found = finder.search(texts)
    assert any(f[0] == 2 for f in found[3])
    ids, block, first = decontaminate._laid_out(texts)
    edges, want, leaks = np.searchsorted(block, first), 0, []
    for i, text in enumerate(texts):
        words, best = decontaminate.words_of(text), {}
        for own in range(int(first[i + 1] - first[i])):
            window = collections.Counter(ids[edges[i] :][max(0, own - 1) * 32 : min((own + 3) * 32, len(words))].tolist())
            for j, part in enumerate(finder.parts):
                need = collections.Counter(decontaminate.term_ids(part.words).tolist())
                want += sum((window & need).values()) >= 10
                share, answer, leak = decontaminate.leaks(part, words[max(0, own - 1) * 32 : (own + 3) * 32])
                if leak and (j not in best or best[j][1] < share):
                    best[j] = (j, share)
        leaks.append({j: share for j, share in best.values()})
    assert len(looked) == want and [{f[0]: f[1] for f in x} for x in found] == leaks


def test_quality_rules_deal_out_no_text_for_a_few_frequent_lines(spark, monkeypatch):
    """One pass over the texts gives what the join of verdicts gives, odd rows included; the join stays for lines that are too many to be sent out."""
    own = lambda i: "\n".join(" ".join(f"d{i}w{j}x{k}" for k in range(12)) for j in range(5))
    line, long = "all  pages say This", " ".join(f"p{i}" for i in range(200))
    rows = [(i, f"{own(i)}\n \n{line if i % 2 else line.upper()}\n" + (long if i % 3 == 0 else ""), "en", ("big", None, "small")[i % 3], i) for i in range(60)]
    rows += [(7, None, "en", "big", 0), (7, "", "en", None, 0), (None, own(7), None, "big", 1), (3, own(3) + "\n" + line, "en", "big", 9), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = quality.clean(docs)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(quality, "fits_broadcast", lambda *a: False)
    joined = quality.clean(docs)
    got, want = (sorted(map(repr, x.collect())) for x in (once, joined))
    # of the host big all rows with the long line are depleted; the line is frequent on every host
    assert got == want and len(got) == 40 + 2 and once.columns == docs.columns and not any(line.lower() in x.lower() for x in got)
