import random

import pytest

from motif.llm import html, langid, substrings
from motif.llm.common import connected_components


def chosen(word):
    """The fixed rule for words that end a sentence: length and three bytes, mixed, a multiple of eight."""
    raw = word.lower().encode()
    x, m = raw[0] | raw[-1] << 8 | raw[(len(raw) - 1) // 2] << 16 | len(raw) - 1 << 24, 2**64 - 1
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * c & m
    return (x ^ x >> 33) % 8 == 0


def brute_sentences(text):
    """The pieces of a text that end with marks, lines, or chosen words; written word by word."""
    pieces, begin, at, ended = [], 0, 0, False
    for line in text.split("\n"):
        for word in line.split():
            start = text.index(word, at)
            if ended:
                pieces.append(text[begin:start])
                begin = start
            at = start + len(word)
            ended = (word.rstrip("\"')]") or word[0])[-1:] in (".", "!", "?") or chosen(word)
        ended = ended or text[begin:at].strip() != ""
        at = text.find("\n", at) + 1 or len(text)
    return [*pieces, text[begin:]] if text.strip() else []


def brute_removed(docs, sentences=2, words=12):
    """Sentences that any non-first place of any run covers, by comparing all runs; of each stretch the whole ones by marks and lines."""
    places = {}
    for doc, text in docs:
        parts = [s.lower().split() for s in brute_sentences(text)]
        real = [i for i, p in enumerate(parts) if p]
        for k in range(len(real)):
            for j in range(k + sentences, len(real) + 1):
                run = tuple(" ".join(parts[i]) for i in real[k:j])
                if sum(len(parts[i]) for i in real[k:j]) >= words:
                    places.setdefault(run, []).append((doc, real[k], real[j - 1] + 1))
    gone = {}
    for found in places.values():
        for doc, a, b in sorted(found)[1:]:
            gone.setdefault(doc, set()).update(range(a, b))
    for doc, text in docs:
        if left := gone.get(doc):
            parts = brute_sentences(text)
            ends = [p.rstrip("\"')] \n")[-1:] in (".", "!", "?") or "\n" in p or i == len(parts) - 1 for i, p in enumerate(parts)]
            for a in [i for i in left if i - 1 not in left]:
                b = next(i for i in range(a, len(parts) + 1) if i not in left)
                whole = [(x, y) for x in range(a, b) for y in range(x + 1, b + 1) if (x == 0 or ends[x - 1]) and ends[y - 1]]
                if whole:
                    x, y = max(whole, key=lambda p: p[1] - p[0])
                    left -= set(range(a, b)) - set(range(x, y))
    return gone


def test_repeated_spans_equal_brute_force_over_all_runs(make):
    rng = random.Random(8)
    pool = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=rng.randint(1, 12))).capitalize() + rng.choice([". ", "! ", ".\n", "\n\n", " "]) for _ in range(40)]
    docs = [(i, "".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(60)]
    passage = "One long passage starts here and goes on. It has several sentences in it! Every one of them repeats later, and it has words enough for a run. "
    docs += [(100, "Own words first and " + passage + "Own end."), (90, passage + "Another end of nine plain words in this text.")]
    # The run that begins with the second sentence is too short: only the shortest run that ends with the last one covers it.
    tail = "".join(f"{n} two three four five six seven eight nine ten. " for n in ("One", "Other")) + "Six seven eight nine ten eleven twelve. Last bit.\n"
    docs += [(200, tail + "Then words of its own follow."), (201, tail + "Here is something else.")]
    docs += [(300, " leading, \n\n\n and blank \n \n lines\n"), (301, "\n"), (302, "   "), (303, "mark\u3002another\uff01 third")]
    docs += [(400 + i, "the same line of junk " * 30) for i in range(3)]
    gone = brute_removed(docs)
    for r in substrings.remove_repeats(make(docs).drop("removed")).collect():
        parts = substrings.split_sentences(dict(docs)[r["doc_id"]])
        assert "".join(parts) == dict(docs)[r["doc_id"]]
        assert r["doc_id"] in (301, 302, 303) or parts == brute_sentences(dict(docs)[r["doc_id"]])
        left = gone.get(r["doc_id"], set())
        assert r["text"] == "".join(p for i, p in enumerate(parts) if i not in left) and r["n_removed"] == len(left)
        assert r["n_sentences"] == (0 if r["doc_id"] in (301, 302) else len(parts))
        assert r["doc_id"] != 201 or r["text"].strip() == "Here is something else."
    assert len(gone[100]) >= 3 and 90 not in gone
    assert substrings.split_sentences("mark\u3002another\uff01 third")[:2] == ["mark\u3002", "another\uff01 "]


def test_substrings_of_nulls_repeats_and_empty_tables(make):
    text = "One sentence with plenty of words in it. Another sentence with plenty of words too. " * 2 + "And one more."
    rows = [(2, text), (2, text), (None, text), (1, None), (3, ""), (4, "short."), (5, "word, " * 5000)]
    docs = make(rows).drop("removed")
    got = {(r["doc_id"], r["text"]) for r in substrings.remove_repeats(docs).collect()}
    once = "One sentence with plenty of words in it. Another sentence with plenty of words too. And one more."  # the second time goes
    assert got == {(2, once), (None, ""), (1, None), (3, ""), (4, "short."), (5, next(t for i, t in got if i == 5))}
    assert substrings.remove_repeats(docs.limit(0)).collect() == []
    # A column with the name of a new one gives way to it.
    assert substrings.remove_repeats(make(rows[:1])).first()["removed"] == ["84:168"]


WORDS = {"aa": "tion eau mente querre aime", "bb": "schung keit aber heit nicht", "cc": "thing wher ough ness ing"}


def corpus(n=300):
    rng = random.Random(9)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join("".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(2, 60))), lang))
    return out


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", None), (1003, "漢字仮名交じり文", None), (None, rows[0][1], "aa"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    found = [(r["doc_id"], r) for r in langid.predict(docs, model, ["doc_id"]).collect()]
    held = [(i, r) for i, r in found if i is not None and i < 1000 and langid.crc_mod(i) == 0]
    truth = {i: lang for i, _, lang in rows}
    assert len(held) > 30 and all(r["lang_pred"] == truth[i] and not r["rejected"] for i, r in held)
    by = dict(found)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] in model.languages and by[1003]["rejected"]
    assert all(0 <= r["score"] <= 1 for _, r in found)
    assert len(found) == len(rows) + len(extra)
    marked = docs.withColumn("h", langid.held_out()).collect()
    assert all(r["h"] == (r["doc_id"] is not None and langid.crc_mod(r["doc_id"]) == 0) for r in marked)


def test_foreign_texts_of_any_length_are_rejected(spark):
    rng = random.Random(10)
    common = {"en": "the of and to that was with for his they have this from were there which their would about been", "fi": "oli ja hän että kuin mutta joka sitä olla vain talossa metsän järvellä kaupunkiin iltapäivällä"}
    ends = "tion ment ing ness ous ed er ly able ward"
    rows = []
    stems = "sta rea form light count power water inter press hand work read build call".split()
    for i in range(400):
        words = [rng.choice(common["en"].split()) if rng.random() < 0.6 else rng.choice(stems) + rng.choice(ends.split()) for _ in range(rng.choice([3, 40, 400]))]
        rows.append((i, " ".join(words), "en"))
    rows += [(400, "qx zj " * 40, "en"), (401, "w", "en")]  # odd rows
    foreign = {
        "hangul": lambda: "".join(chr(rng.randint(0xAC00, 0xD7A3)) for _ in range(3)),
        "greek": lambda: "".join(rng.choices("αβγδεζηθικλμνοπρστυφχψω", k=5)),
        "random": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))),
        "fi": lambda: rng.choice(common["fi"].split()),
    }
    far = [(1000 + len(foreign) * i + j, " ".join(word() for _ in range(n)), None) for i, n in enumerate((30, 500, 3000)) for j, word in enumerate(foreign.values())]
    near = [(2000, "that was the station of their", None), (2001, "there", None)]
    docs = spark.createDataFrame(rows + far + near, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["rejected"] for r in langid.predict(docs, langid.train(docs), ["doc_id"]).collect()}
    assert all(found[i] for i, _, _ in far) and not any(found[i] for i in [*range(400), 2000, 2001])


def plain_features(text):
    """Hashed n-grams of a text, counted one by one."""
    letters = [ch.lower() if len(ch.lower()) == 1 else ch for ch in text if True]
    spaced = " ".join("".join(x if x.isalpha() else " " for x in letters).split())
    x = [ord(ch) for ch in f" {spaced} "]
    out, m = {}, 2**32 - 1
    for i in range(1, len(x) - 1):
        two = (x[i] * 0x9E3779B1 & m) ^ (x[i + 1] * 0x85EBCA6B & m)
        three = two ^ (x[i - 1] * 0xC2B2AE35 & m)
        for h in (two, (three ^ three >> 15) * 0x27D4EB2F & m, x[i] * 0x165667B1 & m):
            out[h >> 16] = out.get(h >> 16, 0) + 1
    return out


def test_predictions_equal_plain_cosines(spark):
    """Every text against every centroid with dicts, ties to the first language; long texts and letters beyond 16 bits too."""
    import math

    rows = corpus(200)
    astral = "".join(chr(0x10400 + i % 40) for i in range(60))
    extra = [(900, "thing wher ough " * 30_000, None), (901, astral, None), (902, "\U0001f600 12", None), (903, rows[0][1], None), (904, rows[0][1], None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "lang as lang_pred", "1.5 as score")
    model = langid.train(docs)
    found = {r["doc_id"]: r for r in langid.predict(docs, model, ["doc_id", "score"]).collect()}
    table = langid.letter_table()
    for i, text, _ in rows[:40] + extra:
        tf = plain_features(text)
        if i == 902:
            assert found[i]["lang_pred"] == "und" and langid.counts(text, table) is None
            continue
        if i != 900:  # the long text is read in parts: the space between two of them isn't repeated
            assert {k: int(n) for k, n in enumerate(langid.counts(text, table)) if n} == tf
        v = {k: math.log1p(n) * model.idf[k] for k, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x / norm * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert abs(found[i]["score"] - max(0.0, cosines[best])) < (1e-2 if i == 900 else 1e-5) and found[i]["lang_pred"] == model.languages[model.owner[best]]
    assert found[901]["rejected"] and found[903]["score"] == found[904]["score"]


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.train(docs), ["doc_id"]).first()["lang_pred"] == "und"
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0)), ["doc_id"]).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept all of them now please.</div>%s
<aside>Related things</aside><div id="comments"><p>First! A very long reader comment that goes on and on, with many words.</p></div>
<form><label>Name</label><input name=x></form><footer>&copy; Us</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>One  two\n three.</p><p><b>Four<br>five<p>Six&nbsp;seven.</article>", "A & B\nOne two three.\nFour five\nSix seven."),
        ("<main><div class=ad>Buy</div><h2>H</h2><div><p>Text of some length here, with a <a href=x>link</a> in it.</p></div></main>", "H\nText of some length here, with a link in it."),
        ("<div id=content><h1>Head</h1><p>A first long paragraph of text without any mark up.</p><ul><li>One item<li>Two items</ul><p>A second long paragraph of text.</p></div>",
         "Head\nA first long paragraph of text without any mark up.\nOne item\nTwo items\nA second long paragraph of text."),
        ("<article><p>It's a <i>quote's</i> end < 5 &lt;b&gt; &#233;&eacute;.</p><!-- <p>no</p> --></article>", "It's a quote's end < 5 <b> éé."),
    ],
)
def test_main_text(body, want):
    assert html.extract(PAGE % body) == want


def test_text_in_several_parts_is_whole():
    three = lambda k: "".join(f"<p>{f'part {k} paragraph {i} '.ljust(300, 'x')}</p>" for i in range(3))
    lead = f"<p>{'lead '.ljust(300, 'y')}</p>"
    link = "<ul><li><a href=a>One place to go</a><li><a href=b>Another place to go</a></ul>"
    for parts in (2, 3):
        body = f"<div id=page><div>{link}</div><div>{lead}<div id=story>" + "".join(f"<div>{three(k)}</div>" for k in range(parts)) + f"</div></div><div>{link}</div></div>"
        found = html.extract(PAGE % body).split("\n")
        assert len(found) == 1 + 3 * parts and found[0].startswith("lead")
        assert [t[:18] for t in found[1:]] == [f"part {k} paragraph {i}" for k in range(parts) for i in range(3)]


def plain_density(n, body):
    """A node's density and the sum of its children's, from the definition, with recursion."""
    import math

    def count(n):
        c = t = lc = lt = 0
        for x in n.items:
            if isinstance(x, str):
                c += len(x.strip())
            elif not x.hidden:
                k = count(x)
                c, t, lc, lt = c + k[0], t + 1 + k[1], lc + k[2], lt + k[3] + (x.tag == "a")
        return (c, t, c if n.tag == "a" else lc, lt)

    def density(n):
        c, t, lc, lt = count(n)
        if not c:
            return 0.0
        bc, _, bl, _ = count(body)
        base = math.log(math.log(c * lc / max(1, c - lc) + bl / max(1, bc) * c + math.e) + math.e - 1)
        return c / max(1, t) * max(0.0, math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) + 1e-3) / base

    return density(n), sum(density(x) for x in n.items if not isinstance(x, str) and not x.hidden)


def test_densities_and_the_chosen_subtree_equal_the_definition():
    rng = random.Random(12)

    def tree(depth):
        tag = rng.choice(["div", "p", "section", "ul", "b", "a", "nav", "span", "script"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}>{'t' * rng.randint(0, 80)}{inner}</{tag}>"

    for _ in range(30):
        _, nodes = html.parse("<html><body>" + "".join(tree(4) for _ in range(4)) + "</body></html>")
        html.measure(nodes)
        body = next(n for n in nodes if n.tag == "body")
        seen = [n for n in nodes if not n.hidden]
        for n in seen:
            density, total = plain_density(n, body)
            assert abs(n.density - density) < 1e-9 and abs(n.sum - (total if n.chars else 0)) < 1e-9
        holders = [n for n in seen if n is body or any(not isinstance(x, str) and not x.hidden and x.tag in html.BLOCKS for x in n.items)]
        core = html._core(body, list(html._within(body)))
        assert core.sum == max([body.sum, *(n.sum for n in holders)]) or 2 * html._own(core) > core.chars


def test_text_that_stands_directly_in_the_body():
    text, more = ("word and more words " * 42).strip(), ("other words come here " * 22).strip()
    assert html.extract(f"<html><body>{text}<br><br>{more}<p>The end.</p></body></html>") == f"{text} {more}\nThe end."
    assert html.extract(f"<html><body><h1>Title</h1>{text}<br>{more}</body></html>") == f"Title\n{text} {more}"
    assert html.extract("<html><body>plain body text only</body></html>") == "plain body text only"
    assert html.extract(f"{text}<br>{more}") == f"{text} {more}"
    assert html.extract(f"<html><body>{text}<br>{text}<div><p>{more}</p><p>{more}</p></div></body></html>") == f"{text} {text}\n{more}\n{more}"
    assert html.extract(f"<html><body><table><tr><td>{text}<br>{more}<p>x</p></td></tr></table></body></html>") == f"{text} {more}\nx"


def test_density_finds_the_text_of_pages_without_article_or_main():
    """Neither elements nor names say where the text is; lists of links and short lines stand around it."""
    rng = random.Random(15)
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{k}>{'link ' * rng.randint(1, 4)}</a>" for k in range(n)) + "</ul>"
    for _ in range(40):
        paragraphs = [("word " * rng.randint(30, 90)).strip() for _ in range(rng.randint(3, 9))]
        text = "".join(f"<p>{p}</p>" for p in paragraphs)
        inner = f"<div><div>{text}</div></div>" if rng.random() < 0.5 else f"<td>{text}</td>"
        page = f"<html><body><div><div>{links(12)}</div><table><tr>{inner}</tr></table><div>{links(9)}</div><div>{links(5)}</div></div></body></html>"
        assert html.extract(page) == "\n".join(paragraphs)


def test_reader_comments_longer_than_the_text_are_pruned_and_long_pages_are_whole(spark):
    text = "".join(f"<p>{'word ' * 40}</p>" for _ in range(3))
    comments = "<div id=comments>" + "".join(f"<div><p>{'reply ' * 90}</p></div>" for _ in range(9)) + "</div>"
    assert html.extract(f"<html><body><div><div>{text}</div>{comments}</div></body></html>").count("word") == 120
    assert "reply" not in html.extract(f"<html><body><article>{text}{comments}</article></body></html>")
    long = "<article>" + "".join(f"<p>{'many words stand in this paragraph of a long page ' * 5}{k}</p>" for k in range(8000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", long, "t", 7)], "page_id long, url string, html string, text string, n_chars long")
    row = html.extract_column(pages).first()
    assert row["text"].count("\n") == 7999 and row["n_chars"] == len(row["text"]) and row["text"].endswith("7999")


def test_names_and_forms_do_not_take_the_text_away():
    text = "<h2 id='related-work'>Other work</h2><p>%s</p><section id='notice-period'><h3 id='how-to-login'>How to</h3><p>Some more of it.</p></section>" % ("word " * 60)
    want = "\n".join(["Other work", " ".join(["word"] * 60), "How to", "Some more of it."])
    assert html.extract(PAGE % f"<article>{text}</article>") == want
    for wrap in ("<form id=aspnetForm>%s</form>", "<div class='sidebar-right'>%s</div>", "<form><div id=search-page>%s</div></form>"):
        page = wrap % f"<div class=menu><p>Places to go</p></div><article>{text}</article><div id=comments><p>{'long comment ' * 90}</p></div>"
        assert html.extract(f"<html><body>{page}</body></html>") == want
    assert html.extract("<body><form><label>Name</label><input name=x></form><p>Text</p></body>") == "Text"
    assert html.extract("<body><div class=ad>A long advert beside it.</div><article>Short.</article></body>") == "Short."


def test_pages_of_nulls_and_broken_markup(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text"), (4, "u", "<p>open <b>never closed"), (5, "u", "</div></p><<>>&bogus;<a href='x"), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (6, "u", "<div>" * 3000 + "deep")]
    found = html.extract_column(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == by[2] == "" and by[3] == "just text" and by[4] == "open never closed" and by[None] == "x" and by[6] == "deep"
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (7, 8), (8, 7), (200, 201)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_passages_without_marks_are_found_at_any_place(make):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(60))
    docs = [(i, " ".join(word() for _ in range(5 + 7 * i)) + " " + passage + " " + " ".join(word() for _ in range(9))) for i in range(6)]
    for r in substrings.remove_repeats(make(docs)).collect():
        text = dict(docs)[r["doc_id"]]
        gone = len(text.split()) - len(r["text"].split())
        assert gone == 0 if r["doc_id"] == 0 else 30 <= gone <= 60
        assert "".join(substrings.split_sentences(text)) == text
