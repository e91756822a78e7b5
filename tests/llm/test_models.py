import hashlib
import random

import numpy as np

from graphloom.llm import fingerprints, html_blocks, html_extraction, language_id
from tests.llm.test_dedup import SCHEMA, SF, odd_rows


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    right = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = language_id.language_id(docs).collect()
    apart = [r for r in found if r["held_out"]]
    assert len(found) == len(right) and len(apart) > 20
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in apart) >= 0.95 * len(apart)
    assert all(0 <= r["score"] <= 1 for r in found)
    held = docs.filter(language_id.held_out())
    # A prediction depends on the text alone.
    other = language_id.language_id(held.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source"), model=language_id.fit(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in other} == {r["doc_id"]: r["lang_pred"] for r in apart}


def test_undetermined_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("12 !?", "de"), ("the and of", "en"), ("der und die", "de"), ("the of", None)])]
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [found[k] for k in range(3)] == ["und"] * 3 and found[3] in ("en", "de")
    nothing = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(nothing).first()["lang_pred"] == "und"
    assert language_id.language_id(nothing.filter("false")).count() == 0


def test_documents_with_letters_stay_when_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !?", None), (3, None, None), (4, "", None), (5, "Ä", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language_id.known_documents(docs).collect()) == [1, 5]
    assert language_id.known_documents(docs).dtypes == docs.dtypes


def test_fingerprints_of_documents(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(odd_rows(), SCHEMA), spark.createDataFrame([(4, "abc")], SCHEMA)):
        rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
        found = {r["doc_id"]: r for r in fingerprints.document_fingerprints(docs).collect()}
        assert len(found) == len(rows)
        for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            r, half = found[d], len(text) // 2
            changed = text[: len(text) - half] + after[:half]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            mine, edited, following = fingerprints.fingerprints([text.encode(), changed.encode(), after.encode()])
            assert (r["fingerprint"], r["edited_fingerprint"]) == (mine, edited)
            assert abs(r["near_edited"] - fingerprints.likeness(mine, edited)) < 1e-12
            assert abs(r["near_next"] - fingerprints.likeness(mine, following)) < 1e-12


def plain_phrases(text, levels):
    """Locally consistent parsing one symbol at a time: the phrases of each level as tuples of what they hold."""
    def toss(symbol, left):
        if left is None:
            return symbol & 1
        bit = ((symbol ^ left) & -(symbol ^ left)).bit_length() - 1
        return 2 * bit + (symbol >> bit & 1)

    # Names stand for phrases: the library's own, so that bits agree; boundaries and contents are found here.
    out, symbols = [], list(text)
    for level in range(1, levels + 1):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        colour = [r[0] for r in runs]
        for _ in range(3 if level == 1 else 4):
            colour = [toss(c, colour[k - 1] if k else None) for k, c in enumerate(colour)]
        n = len(runs)
        begin = [k for k in range(n) if k == 0 or 1 < k < n - 1 and colour[k] < colour[k - 1] and colour[k] < colour[k + 1]]
        phrases = [tuple(map(tuple, runs[a:b])) for a, b in zip(begin, [*begin[1:], n], strict=True)]
        names, _ = fingerprints.level_up(np.array(symbols, np.uint8 if level == 1 else np.uint64), np.array([0, len(symbols)]))
        assert len(names) == len(phrases)
        same = {}
        for name, phrase in zip(names.tolist(), phrases, strict=True):
            assert same.setdefault(phrase, name) == name
        assert len(set(same.values())) == len(same)
        out.append(phrases)
        symbols = names.tolist()
    return out


def test_phrases_against_a_plain_parser():
    rng = random.Random(8)
    for text in (b"", b"a", b"aaaa", b"ab" * 300, bytes(rng.choice(b"ab") for _ in range(700)), bytes(rng.choice(b"abcdefgh ") for _ in range(2000)), bytes(rng.randrange(256) for _ in range(900)), b"x" * 100 + b"y"):
        if text:
            phrases = plain_phrases(text, 4)
            assert all(sum(k for _, k in p) >= 1 for level in phrases for p in level)


def test_repeated_and_null_ids_have_fingerprints(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, "x" * 3000), (None, None), (3, "d"), (9, "long text " * 30_000)]
    found = fingerprints.document_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in found) == sorted((d or -1, len(t or "")) for d, t in rows)
    assert len({r["fingerprint"] for r in found if r["n_chars"] == 5}) == 1
    assert fingerprints.document_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(2)
    letters = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage = letters(5000)

    def names(text, level):
        symbols, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        for _ in range(level):
            symbols, offsets = fingerprints.level_up(symbols, offsets)
        return set(symbols.tolist()), len(symbols)

    for level in (1, 2, 3):
        alone, n = names(passage, level)
        for lead in (0, 1, 2, 3, 17, 1000):
            within, _ = names(letters(lead) + passage + letters(lead), level)
            assert len(alone - within) <= 30, (level, lead)
        assert n < 5000 / 2**level


def test_blocks_of_malformed_markup():
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text("<p>a<br>b <b>c<p>d &amp; e&nbsp;f") == ["a b c", "d & e f"]
    assert text("<script>var t='</p>'</script><p>x<!-- <p>y</p> --></p><style>p{}") == ["x"]
    assert text("<p title='a>b'>1 < 2</p><![CDATA[z]]><ul><li>a<li>b</ul>") == ["1 < 2", "z", "a", "b"]
    assert text("<p>cut off <a hre") == ["cut off"]
    assert text("") == text("<div></div>") == []


def test_open_elements_are_found_at_any_depth():
    paths = lambda page: [b.path for b in html_blocks.blocks(page)]
    assert paths("<nav>" + "<div>" * 2000 + "menu</nav><main>text") == [("nav", *["div"] * 2000), ("main",)]
    assert paths("<p>" + "<b>" * 100 + "one<p>two")[1] == ("p",)
    assert paths("<ul><li>" + "<div>" * 100 + "one<li>two")[1] == ("ul", "li")
    assert paths("<table><tr><td>" + "<div>" * 100 + "one<tr><td>two")[1] == ("table", "tr", "td")
    # Cells of a table within a cell, and a link's end beyond a block, leave what is outside open.
    assert paths("<table><tr><td><table><tr><td>one<td>two</table>three")[1:] == [("table", "tr", "td", "table", "tr", "td"), ("table", "tr", "td")]
    assert paths("<a><div>one</a>two</div>") == [("a", "div")]


def test_main_text_of_generated_and_given_pages(spark):
    model = html_extraction.train()
    rng, right, total = random.Random(77), 0, 0
    for _ in range(150):
        source, main = html_extraction.page(rng)
        found = html_blocks.blocks(source)
        if len(found) == len(main):
            right += int((html_extraction.label(model, [found])[0] == np.array(main)).sum())
            total += len(main)
    assert right >= 0.98 * total
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in html_extraction.extract_text(pages, model).collect()}
    for r in pages.collect():
        inside = [b.text for b in html_blocks.blocks(r["html"]) if any(e.split()[0] == "article" for e in b.path)]
        assert found[r["page_id"]]["text"] == " ".join(inside)
        assert found[r["page_id"]]["n_chars"] == len(" ".join(inside))
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_extraction.extract_text(odd, model).collect()] == ["", "", ""]


def test_long_pages_of_unclosed_elements(spark):
    source = "<nav><div>menu</div></nav><main>" + "<div>some text " * 35_000
    found = html_blocks.blocks(source)
    assert len(found) == 35_001 and found[-1].depth == 35_001
    model = html_extraction.train(60, 1)
    shallow = html_blocks.blocks("<nav class='menu top'><ul><li>a</li></ul></nav><div id=content><p>b<p>c d</div>")
    path = html_extraction.Paths(model.p["paths"])
    for b in shallow:
        assert np.allclose(path(b.element), model.p["paths"][html_extraction.path_parts(b.path)].mean(0), atol=1e-5)
    pages = spark.createDataFrame([(1, "u", source), (2, "v", "<p>x" * 50_000)], "page_id long, url string, html string")
    assert [r["n_blocks"] for r in html_extraction.extract_text(pages, model).collect()] == [35_001, 50_000]


def test_learning_against_plain_steps():
    """Follow-the-regularised-leader one number at a time, and TF-IDF of character n-grams by counting."""
    rng, texts = random.Random(5), []
    for k in range(24):
        texts.append((" ".join(rng.choice([["the", "and", "of"], ["der", "und", "zu"], ["le", "et", "de"]][k % 3]) for _ in range(6)), k % 3))
    counts = []
    for text, _ in texts:
        own = {}
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                at, _ = language_id.features(text[i : i + n])
                whole = [a for a in at.tolist() if a not in {x for m in range(1, n) for j in range(n - m + 1) for x in language_id.features(text[i + j : i + j + m])[0].tolist()}] if n > 1 else at.tolist()
                for a in whole:
                    own[a] = own.get(a, 0) + 1
        counts.append(own)
    for (text, _), own in zip(texts, counts, strict=True):
        at, found = language_id.features(text)
        assert sum(found.tolist()) == sum(max(0, len(text) - n + 1) for n in (1, 2, 3))
        assert set(own) <= set(at.tolist())
    idf = np.ones(language_id.DIM)
    rows = [(*((at := language_id.features(t))[0], language_id.weighted(*at, idf)), y) for t, y in texts]
    z, n = {}, {}
    weight = lambda a, c: 0.0 if abs(z.get((a, c), 0.0)) <= language_id.L1 else -(z[a, c] - np.sign(z[a, c]) * language_id.L1) / ((language_id.BETA + n[a, c] ** 0.5) / language_id.ALPHA + language_id.L2)
    order = np.random.default_rng(1)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            scores = [sum(v * weight(a, c) for a, v in zip(at.tolist(), x.tolist(), strict=True)) for c in range(3)]
            e = [np.exp(s - max(scores)) for s in scores]
            before = {(a, c): weight(a, c) for a in at.tolist() for c in range(3)}
            for a, v in zip(at.tolist(), x.tolist(), strict=True):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    old = n.get((a, c), 0.0)
                    n[a, c] = old + g * g
                    z[a, c] = z.get((a, c), 0.0) + g - (n[a, c] ** 0.5 - old**0.5) / language_id.ALPHA * before[a, c]
    learned = language_id.learn(rows, 3)
    for (a, c) in z:
        assert abs(learned[a, c] - weight(a, c)) < 1e-9
    assert np.count_nonzero(learned) <= len(z)


def test_repeated_and_long_texts_have_one_language(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog of it", "en"), ("der hund und die katze zu", "de")] * 20)]
    rows += [(100, "the and of " * 100_000, None), (101, "the and of it", None), (101, "the and of it", None)]
    found = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in found if r["doc_id"] >= 100} == {"en"}
    assert len({r["score"] for r in found if r["doc_id"] == 101}) == 1
