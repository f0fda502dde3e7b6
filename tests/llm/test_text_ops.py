import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from marrow.llm import decontam, groups, language, line_dedup, piece_table, quality, style_tree, token_files, toxicity  # noqa: E402
from marrow.llm.training import remainder, scored  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "word " * 40_000 + "end"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def docs(spark, rows):
    """Rows (id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", [1]) for i, t in rows], "doc_id long, text string, line string, pos int, id string, words array<int>")


# line dedup
def dedup(rows, min_chars=10):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(key(x)) >= min_chars and len(holders[key(x)]) > 1 and i != min(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def some_lines(rng, n):
    pool = ["short", "A common line here", "\ta COMMON line here \r", "éééééééééé x", "ÉÉÉÉÉÉÉÉÉÉ x", "0123456789", "", "  ", "unique %d"]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join((p % rng.randint(0, 50) if "%" in (p := rng.choice(pool)) else p) for _ in range(rng.randint(1, 8)))) for i in range(n)]


def test_line_dedup_matches_brute_force(spark):
    rows = some_lines(random.Random(3), 200)
    rows += [(7000, LONG), (7001, LONG), (7002, "\n".join(["a line that is very common"] * 3000)), (7003, "a line that is very common")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_report(docs(spark, rows)).collect())
    assert got == sorted((i is not None, i or 0, n, k, t) for i, n, k, t in dedup(rows))


def test_line_dedup_hot_keys_go_another_way(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_ROWS", 20)
    monkeypatch.setattr(groups, "HOT_KEYS", 1)
    rows = [(i, f"the very same line\nline number {i % 4} of four\nmine {i}") for i in range(60)]
    got = sorted((r.doc_id, r.n_dropped, r.kept) for r in line_dedup.line_report(docs(spark, rows)).collect())
    assert got == sorted((i, k, t) for i, _, k, t in dedup(rows))


def test_line_dedup_rewrite_and_edges(spark):
    d = docs(spark, [(1, "one shared line\nx"), (2, "one shared line\ny"), (2, "one shared line\ny"), (None, "one shared line"), (3, None)])
    out = line_dedup.rewrite(d)
    assert out.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, "one shared line\nx"), (2, "y"), (2, "y"), (None, "one shared line"), (3, None)])
    assert line_dedup.line_report(d.limit(0)).count() == 0
    thrice = line_dedup.line_report(docs(spark, [(1, "in three documents"), (2, "in three documents\nin two documents"), (3, "in three documents\nin two documents")]), min_docs=3)
    assert {r.doc_id: r.n_dropped for r in thrice.collect()} == {1: 0, 2: 1, 3: 1}


# decontamination
def hits(text, items):
    words, covered, found = WORD.findall(lower(text or "")), set(), []
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(len(w), 8)
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in runs] if runs else []
        covered.update(p for i in at for p in range(i, i + n))
        found += [str(item)] * bool(at)
    return len(words), len(covered), sorted(found)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "the", "日本"])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 14)))) for k in range(12)] + [(90, None), (91, "!!"), (92, "Two Words"), (93, "two words")]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "x " + items[3][1].upper() + " y"), (104, LONG + " two-words"), (105, "two"), (105, "two")]
    rows += [(106, "two words"), (106, "x"), (None, "see two words here"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is not None, *map(str, r))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs(spark, rows), bench).collect()), key=key)
    assert got == sorted(((i, *hits(t, items)) for i, t in rows), key=key)
    clean = decontam.without_hits(docs(spark, rows), bench)
    assert clean.columns == docs(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(((i, t) for i, t in rows if not hits(t, items)[2]), key=key)


def test_decontamination_by_shuffle_and_without_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    text = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    (r,) = decontam.contamination(docs(spark, [(1, "zero " + text.upper())]), bench).collect()
    assert (r.n_words, r.n_hit, r["items"]) == (10, 9, ["1"])
    (r,) = decontam.contamination(docs(spark, [(1, text)]), bench.limit(0)).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (9, 0, 0)
    assert decontam.contamination(docs(spark, [(1, text)]).limit(0), bench).count() == 0


def test_winnowing_keeps_a_hash_of_every_shared_window(spark):
    rng = random.Random(1)
    a = [rng.randint(0, 9) for _ in range(300)]
    df = spark.createDataFrame([(a[k : k + 8],) for k in range(290)], "h array<long>")
    whole = set(spark.createDataFrame([(a,)], "h array<long>").select(decontam._winnowed(F.col("h"), 8, 4).alias("w")).first().w)
    assert all(set(r.w) <= whole and len(r.w) == 1 for r in df.select(decontam._winnowed(F.col("h"), 8, 4).alias("w")).collect())


# SentencePiece
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts(seed, letters, n=3000, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_sentencepiece_matches_the_library(spark):
    sp = piece_table._processor(PIECES)
    all_texts = texts(1, list("ab \n\t  ▁é$#1<s>日🙂\x00|")) + [" ", "", "a ", "  ", "\n", "<unk> </s> <0x0A>", LONG]
    table = piece_table.ChunkTable(PIECES)
    assert [np.frombuffer(b, "<i4").tolist() for b in table.encode(all_texts)] == [sp.encode(t) for t in all_texts]
    d = docs(spark, [(i, t.replace("\x00", "")) for i, t in enumerate(all_texts[-60:])] + [(None, "x"), (900, None)])
    for r in piece_table.encode(d, PIECES).collect():
        t = "x" if r.doc_id is None else "" if r.doc_id == 900 else all_texts[-60:][r.doc_id].replace("\x00", "")
        assert r.ids == sp.encode(t) + [2] and r.decoded == sp.decode(r.ids)
    assert piece_table.encode(d.limit(0), PIECES).count() == 0


def test_sentencepiece_table_may_overflow(monkeypatch):
    monkeypatch.setattr(piece_table, "TABLE_ROWS", 3)
    table, sp = piece_table.ChunkTable(PIECES), piece_table._processor(PIECES)
    for t in ["a b c d e", "f g h", "a f"]:
        assert np.frombuffer(table.encode([t])[0], "<i4").tolist() == sp.encode(t)


# token files
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_words_are_tokenized_as_the_library_does():
    table = token_files.WordTable(BPE)
    all_texts = texts(2, list("ab \n\t  é$#1<s>日🙂\x00|'sĠ\x1c\x85　")) + [t.strip() for t in texts(3, list("ab  \né1,.'s"))] + [" ", "", "<|endoftext|> a <|endoftext|>b", "a b\nc d\n<|endoftext|>\nb", "Ġa Ġb\nĊ Ċ"]
    flat, counts = table.encode(pa.array(all_texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [table._one(t) for t in all_texts]


def test_codes_survive_packing():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 1003):
        ranks = rng.integers(0, 1 << 31, n) >> rng.integers(0, 31, n)
        control, data = token_files.pack(ranks)
        assert (token_files.unpack(control, data, n) == ranks).all() and len(control) == -(-n // 4)


def test_token_files_hold_documents_in_order(spark, tmp_path):
    rows = [(5, "five"), (1, "one one"), (None, "nobody"), (3, None), (2, ""), (5, "five"), (9, LONG)]
    path = f"file://{tmp_path}/t"
    token_files.write(docs(spark, rows), path, BPE)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    tok, at = token_files._tokenizer(BPE), 0
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5, 9]
    by_id = dict(rows)
    for r in got:
        ids = [*tok.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    counts = [r["count"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True) and sum(counts) == at
    token_files.write(docs(spark, rows).limit(0), f"{path}-empty", BPE)
    assert token_files.read(spark, f"{path}-empty").count() == 0


# classifiers
def corpus(n, bad_word, seed=0):
    rng = random.Random(seed)
    syllable = ["ta", "ren", "lo", "mi", "sho", "ke", "un"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllable) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), bad_word)
        out.append((i, " ".join(words), int(y)))
    return out


@pytest.mark.parametrize("operator, column, bad", [(toxicity, "toxic", "vilezork"), (quality, "quality", "$$$ ### %%%")])
def test_classifiers_learn_and_stand_edges(spark, operator, column, bad):
    rows = corpus(400, bad)
    d = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows] + [(0, 0, "twice"), (None, 1, "z"), (5, None, "z")], f"doc_id long, {column} int, text string")
    model = operator.train(d, labels, remainder("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in scored(d, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.95
    odd = scored(docs(spark, [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "x")]), model).collect()
    assert len(odd) == 5 and all(0 <= r.score <= 1 for r in odd)
    for few in (labels.limit(0), labels.filter(f"{column} = 1")):
        assert {0 <= s <= 1 for s in operator.train(d, few).score(["a", ""])} == {True}


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-50, min(50, z))))


def toxic_by_hand(model, text):
    """n-gram by n-gram, in Python integers."""
    chars, weight, found = [ord(c) for c in f" {text.lower()} "], dict(zip(model.ids.tolist(), model.weights)), set()
    for n in (3, 4, 5, 6):
        for i in range(len(chars) - n + 1):
            h = chars[i]
            for c in chars[i + 1 : i + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            found.add((((h ^ h >> 15) * 0x9E3779B1) & 0xFFFFFFFF) >> 10)
    return sigmoid(model.bias + sum(weight.get(f, 0.0) for f in found))


def quality_by_hand(model, text):
    """Passage by passage: encode, weigh, mix."""
    p, encoded, attention = model.p, [], []
    for x in quality.passages(np.frombuffer(text.encode(), np.uint8)):
        e = [math.tanh(sum(float(v) * float(w) for v, w in zip((x - p["mean"]) / p["std"], column)) + c) for column, c in zip(p["W"].T, p["c"])]
        gate = lambda m: [sum(v * w for v, w in zip(e, column)) for column in m.T]  # noqa: B023, E731
        encoded.append(e)
        attention.append(sum(w * math.tanh(v) * sigmoid(u) for w, v, u in zip(p["w"], gate(p["V"]), gate(p["U"]))))
    weights = [math.exp(a - max(attention)) for a in attention]
    mixed = [sum(w * e[k] for w, e in zip(weights, encoded)) / sum(weights) for k in range(len(encoded[0]))]
    return sigmoid(sum(m * o for m, o in zip(mixed, p["o"])) + p["b"])


def test_passages_by_hand():
    text = ("Ab1 \n" + "the cat sat, " * 90).encode()
    got = quality.passages(np.frombuffer(text, np.uint8))
    assert len(got) == -(-len(text) // 512)
    for k, row in enumerate(got):
        part, grams = text[k * 512 : (k + 1) * 512], Counter()
        for i in range(k * 512, min((k + 1) * 512, len(text) - 2)):
            h = ((text[i] * 65599 + text[i + 1]) * 65599 + text[i + 2]) & 0xFFFFFFFF
            grams[(((h ^ h >> 13) * 0x9E3779B1) & 0xFFFFFFFF) >> 24] += 1
        assert np.allclose(row[:256], [math.sqrt(grams[b] / len(part)) for b in range(256)], atol=1e-5)
        assert np.allclose(row[257:262], [sum(quality._KIND[c] == kind for c in part) / len(part) for kind in range(5)], atol=1e-5)


def language_by_hand(model, text):
    words, cost = language.words_of(text), np.zeros(len(model.langs))
    if not words:
        return "und"
    for w in words:
        if w in model.words:
            cost += model.word_costs[model.words[w]]
            continue
        marked = f"_{w}_"
        for n in range(min(5, len(marked)), 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in model.grams[n - 1]]
            if known:
                cost += sum(model.gram_costs[n - 1][model.grams[n - 1][g]].astype(float) for g in known) / len(known)
                break
        else:
            cost += 7.0
    return model.langs[int(np.argmin(cost))]


def test_scores_match_those_by_hand():
    rows = corpus(300, "vilezörk")
    odd = ["", "a", "ab", "x" * 511, "y" * 512, "Ümläut 日本 🙂 " * 40, "vilezörk"] + [t for _, t, _ in rows[:40]]
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert len(model.ids) and np.allclose(model.score(odd), [toxic_by_hand(model, t) for t in odd], atol=1e-9)
    model = quality.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert np.allclose(model.score(odd), [quality_by_hand(model, t) for t in odd], atol=1e-4)
    model = language.fit([t for _, t, _ in rows], ["ab"[y] for _, _, y in rows])
    assert model.predict(odd)[0] == [language_by_hand(model, t) for t in odd]


def test_attention_is_a_mean_of_passages():
    """A text of equal passages has the score of any of their mixtures; blocks change nothing."""
    rows = corpus(300, "$$$ ### %%%")
    model = quality.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    text = ("talo renmi shoke " * 2000)[: 512 * 60]
    whole = model.score([text])[0]
    block, quality.BLOCK = quality.BLOCK, 7
    try:
        assert abs(model.score([text])[0] - whole) < 0.02
    finally:
        quality.BLOCK = block


def test_letters_are_those_of_unicode():
    assert language.words_of("हिन्दी ½ ② x² E\u0301te ab12cd_x 日本 \U00010140 ①") == ["हिन्दी", "x", "e\u0301te", "ab", "cd", "x", "日本"]
    model = language.fit(["the cat", "the cat", "le chat", "le chat"], ["en", "en", "fr", "fr"])
    assert model.predict(["½ ② ① 12 !", "the"])[0] == ["und", "en"]


def test_rare_languages_are_learned(spark):
    rows = [(i, "the and ing " * 5, "en") for i in range(3000)] + [(5000 + i, "qoxa zuvi " * 5, "zz") for i in range(4)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=200)
    assert model.predict(["qoxa", "ing"])[0] == ["zz", "en"]


@pytest.mark.parametrize("run", [lambda d: scored(d, toxicity.fit([], [])), lambda d: scored(d, quality.fit([], [])), lambda d: language.identify(d, language.fit([], []))])
def test_scores_of_no_rows_and_null_ids(spark, run):
    assert run(docs(spark, []).limit(0)).count() == 0
    assert [r.doc_id for r in run(docs(spark, [(None, None)])).collect()] == [None]


def test_rows_without_a_text_do_not_use_up_the_sample(spark):
    from marrow.llm import training

    d = docs(spark, [(i, "x" * 50 if i % 10 else "short") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 20 == 0) for i in range(-300, 200)], "doc_id long, y boolean").selectExpr("doc_id", "int(y) as y")
    texts_, y = training.labelled(d, labels, F.lit(True), "y", max_rows=20, max_chars=10)
    assert len(texts_) == 20 and sum(y) == 10


def test_tokenizers_of_another_kind_are_refused(tmp_path):
    token_files.check_tokenizer(BPE)
    (tmp_path / "t.json").write_text('{"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE"}}')
    with pytest.raises(ValueError):
        token_files.check_tokenizer(str(tmp_path / "t.json"))


def test_long_texts_are_read_to_the_end():
    rows = corpus(400, "vilezork")
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    clean = "talo renmi " * 200_000
    assert model.score([clean + "vilezork and vilezork or vilezork"])[0] > model.score([clean])[0]
    m = quality.fit([t for _, t, _ in corpus(300, "$$$ ### %%%")], [1 - y for _, _, y in corpus(300, "$$$ ### %%%")])
    assert m.score(["talo renmi " * 100_000 + "$$$ ### %%% " * 100_000])[0] < m.score([clean])[0]


def test_language(spark):
    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "and"], "fr": ["eau", "oui", "é"], "de": ["sch", "ung", "ß"]}
    rows = []
    for i in range(300):
        lang = list(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)), lang))
    d = spark.createDataFrame([*rows, (900, "the", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = language.train(d, remainder("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language.identify(d, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.98
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !?"), (4, LONG), (None, "the and")])
    found = {r.doc_id: (r.lang_pred, 0 <= r.score <= 1) for r in language.identify(odd, model).collect()}
    assert [found[k][0] for k in (1, 2, 3)] == ["und"] * 3 and all(ok for _, ok in found.values()) and found[None][0] == "en"
    assert language.train(d.limit(0)).predict(["the"])[0] == ["und"]


# pages
PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy %d</div><div class="x"><p>%s</p></div><article><h1>Head %d</h1><p><b>First&nbsp;&amp;\n  second %d.<br><p>Third <i>it</i>alic.<section class="comments"><p>me too</p></section></article><footer>&copy; us</footer></body></html>'


def test_pages(spark):
    rows = [(i, "http://H.example.org/a", PAGE % (i, "always the same", i, i)) for i in range(30)]
    rows += [(90, "http://h.example.org/b", None), (91, None, ""), (92, "http://one.example.org", "<p>alone</p> &am"), (93, "x", "<article><p>cut <b"), (0, "http://H.example.org/a", PAGE % (0, "always the same", 0, 0))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(d).collect()}
    assert all(got[i] == f"Head {i} First & second {i}. Third italic." for i in range(30))
    assert (got[90], got[91], got[92], got[93]) == ("", "", "alone &am", "cut")
    assert style_tree.extract(d).count() == len(rows) and style_tree.extract(d.limit(0)).count() == 0


SHELL = '<html class="no-sidebar"><body class="home has-sidebar"><div class="main with-sidebar"><article class="post comments-open related"><p>Story %d</p></article></div><div class="sidebar"><p>Side %d</p></div></body></html>'


def test_names_of_the_layout_do_not_decide(spark):
    d = spark.createDataFrame([(i, "http://h/", SHELL % (i, i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in style_tree.extract(d).collect()} == {i: f"Story {i}" for i in range(12)}
    assert not style_tree.noisy("div", ["no-sidebar"], False) and style_tree.noisy("div", ["left", "sidebar"], False)
    assert style_tree.noisy("div", ["article-header"], False) and not style_tree.noisy("header", ["article-header"], True)


def test_what_comes_back_inside_articles_is_removed(spark):
    page = "<html><body><article><p>%s</p><div class='x'>Read our terms before you go on</div></article></body></html>"
    rows = [(i, "http://many/", page % f"Story {i}") for i in range(40)] + [(100 + i, "http://few/", page % f"Story {i}") for i in range(4)]
    rows += [(200 + i, "http://copies/", page % "Story") for i in range(40)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}" for i in range(40))
    assert all(got[100 + i] == f"Story {i} Read our terms before you go on" for i in range(4))
    assert all(got[200 + i] == "Story Read our terms before you go on" for i in range(40))


def test_menus_and_comments_do_not_take_the_article_with_them(spark):
    page = "<html><body><div class='wrapper'><nav>%s</nav><article><p>Story %d</p></article><div class='text'>Note %d</div><div class='comments'>%s</div></div></body></html>"
    rows = [(i, "http://h/", page % ("Menu of many words " * 30, i, i, f"Comment {i} " * 40)) for i in range(40)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} Note {i}" for i in range(40)}


def test_all_words_of_class_id_and_role_count(spark):
    page = "<html><body><div id='x' class='col wide sidebar'>Side %d</div><div class='a b c left'>Story %d</div><div class='a b c right'>The same</div></body></html>"
    rows = [(i, "http://h/", page % (i, i)) for i in range(40)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(40)}


def test_pages_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(style_tree, "BROADCAST_NODES", 0)
    d = spark.createDataFrame([(i, "http://h/", PAGE % (i, "same", i, i)) for i in range(8)] * 2, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in style_tree.extract(d).collect()]
    assert sorted(got) == sorted([(i, f"Head {i} First & second {i}. Third italic.") for i in range(8)] * 2)


def importance_by_hand(rows):
    """node -> importance, page by page and label by label."""
    pages = {}
    for url, page in rows:
        host = style_tree.host_of(url)
        segments = style_tree.parse(page or "", host)
        pages.setdefault((host, tuple((n.id, t) for n, t in sorted(segments, key=lambda s: s[0].id))), (host, segments))
    seen, kind = {}, {}
    for host, segments in pages.values():
        elements = {}
        for node, _ in segments:
            if all(node is not x for x in elements.setdefault((host, node.id), [])):
                elements[host, node.id].append(node)
        for key, nodes in elements.items():
            seen.setdefault(key, []).append((tuple(tuple(n.kids) for n in nodes), [t for n in nodes for t in n.blocks], sum(n.links for n in nodes)))
            kind[key] = (nodes[0].article, nodes[0].marks)
    own, entropy, dense = {}, {}, {}
    for key, on in seen.items():
        m, times = len(on), Counter(t for _, blocks, _ in on for t in blocks)
        chars = sum(len(t) * k for t, k in times.items())
        back = sum(len(t) * k * np.log(k) for t, k in times.items()) / chars / np.log(max(m, 10))
        content = max(0.0, 1 - back)
        p = np.array(list(Counter(s for s, _, _ in on).values())) / m
        shape = 1.0 if m < 2 else -(p * np.log(p)).sum() / np.log(m)
        own[key], entropy[key], dense[key] = chars * content, content * (0.9 + 0.1 * shape), sum(x for _, _, x in on) > 0.6 * chars
    out = {}
    for host in {h for h, _ in seen}:
        mine = [k for k in seen if k[0] == host]
        all_own = sum(own[k] for k in mine)
        branch = {a: sum(own[k] for k in mine if a in kind[k][1]) for k in mine for a in kind[k][1]}
        most = {a: max(len(seen[k]) for k in mine if a in kind[k][1]) for a in branch}
        step = {k: 201 if not kind[k][1] else -1 if branch[kind[k][1][-1]] < 200 * most[kind[k][1][-1]] else int(200 * branch[kind[k][1][-1]] / max(all_own, 1)) for k in mine}
        upto = 201
        for s in sorted({201, *step.values()}, reverse=True):
            if s < 0 or (s < 201 and sum(own[k] * (10 if kind[k][0] else 1) for k in mine if step[k] > s) >= 0.05 * all_own):
                break
            upto = s
        for k in mine:
            out[k[1]] = entropy[k] + (-0.75 if step[k] < upto else 0.2 if kind[k][0] else -0.75 if dense[k] else 0)
    return out


def test_style_tree_matches_one_by_hand(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["ta", "ren", "lo", "mi"]) for _ in range(n))
    parts = ["<nav><a href='/'>%s</a></nav>", "<div class='ad'>%s</div>", "<div>%s</div>", "<ul><li>%s<li><a>x y z</a></ul>", "<div class='with-sidebar'>%s</div>", "<form><p>%s</p><p>more</p></form>", "<div class='comments'><p>%s</p><div class='reply'>%s</div></div>"]
    rows = []
    for i in range(120):
        host = rng.choice(["a", "b", "c", "d"])
        body = "".join(p.replace("%s", rng.choice(["always the same text", words(rng.randint(1, 90))])) for p in parts if rng.random() < 0.7)
        body += f"<article><h1>{words(3)}</h1>" + "".join(f"<p>{words(30)}</p>" for _ in range(rng.randint(1, 4))) + "</article>" if host != "d" else ""
        rows.append((f"http://{host}.example.org/{i}", f"<html><body>{'<div class=sidebar>' * (host in 'bd')}{body}</body></html>"))
    rows += rows[:9]
    parsed = style_tree._parsed(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, url string, html string"))
    got = {r.node: r.importance for r in style_tree.importance(parsed).collect()}
    want = importance_by_hand(rows)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    assert sum(x < style_tree.LEAST for x in want.values()) > 10 < sum(x >= style_tree.LEAST for x in want.values())


def pages_of(spark, page, n=20):
    rows = [(i, "http://h/", page % {"own": f"Story {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "i": i, "menu": "Menu of many words " * 30, "comment": f"Comment {i} " * 90}) for i in range(n)]
    return {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("page", [
    "<html><body class='home has-sidebar'><article><p>%(own)s</p></article></body></html>",
    "<html><body><main><div class='post-content with-comments'><p>%(own)s</p></div></main></body></html>",
    "<html><body><form id='aspnetForm'><nav>Home %(i)d</nav><div class='widget'><p>%(own)s</p></div></form></body></html>",
    "<html><body><div class='layout-sidebar'><p>%(own)s</p><div class='ad'>Buy %(i)d</div></div><div>%(menu)s</div></body></html>",
    "<html><body><div><ul><li>%(menu)s</ul></div><div><p>%(own)s</p></div><div class='comments'>%(comment)s</div></body></html>",
])
def test_entropy_decides_where_labels_mislead(spark, page):
    got = pages_of(spark, page)
    assert all(got[i] == f"Story {i} " + " ".join(f"w{i}x{k}" for k in range(60)) for i in got)


def test_titles_in_headers_of_articles_stay(spark):
    got = pages_of(spark, "<html><body><header>%(menu)s</header><article><header class='article-header'><h1>Title %(i)d</h1></header><p>%(own)s</p></article></body></html>")
    assert all(got[i].startswith(f"Title {i} Story {i} w") for i in got)


def test_deep_and_long_pages(spark):
    deep = "<html><body>" + "<div class='x ad'>" * 100_000 + "end</p></b></section>" * 1000
    rows = [(1, "http://deep/", deep), (2, "http://long/", "<p>" + LONG), (None, "http://n/", "<p>x")]
    d = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, node int")
    got = {r.page_id: r.text for r in style_tree.extract(d).collect()}
    assert got[1].count("end") in (0, 1000) and got[2] == LONG and got[None] == "x"
