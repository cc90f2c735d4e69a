"""Page repair on a small book made by rule, whose furniture and breaks are known."""

import random

from tracewright.llm import pages as P

WORDS = "lantern keeper market window bridge harbour station captain letter garden village morning teacher basket kitchen painter shoulder promise".split()
S = "page_id bigint, source_id string, pdf_id string, page_index int, text string, image_only boolean, line_kind string"


def book(seed, pages=14, width=46):
    """Pages of running text with a header, a number, breaks and misread words, and the places of all these."""
    r = random.Random(seed)
    lines, here = [], {"hyphen": [], "misread": []}
    for _ in range(pages * 3):
        line = "  "
        for _ in range(r.randrange(30, 60)):
            w = r.choice(WORDS)
            if len(line) + 1 + len(w) > width:
                if r.random() < 0.3 and len(w) > 5:
                    here["hyphen"].append((len(lines), w))
                    lines.append(line + " " + w[:3] + "-")
                    line = w[3:]
                else:
                    lines.append(line)
                    line = w
            else:
                line = line + " " + w if line.strip() else line + w.capitalize()
        lines.append(line + ".")
    out, found = [], set()
    per = 20
    for n in range(0, len(lines), per):
        pid, body = 100 + n // per, lines[n : n + per]
        for k, w in here["hyphen"]:
            if n <= k < n + per and k + 1 < len(lines):
                found.add((pid, k - n + 2, "hyphen", w))
        for k in range(4, len(body), 7):
            # another word and another wrong letter each time
            inner = [w for w in body[k].split()[1:-1] if w in WORDS and "e" in w]
            if inner:
                w = inner[0]
                bad = w.replace("e", "c6oaé3sxwu"[(n // per + k) % 10], 1)
                body[k] = body[k].replace(f" {w} ", f" {bad} ", 1)
                found.add((pid, k + 2, "misread", w))
        found |= {(pid, 0, "furniture", ""), (pid, len(body) + 2, "furniture", "")}
        if n and not body[0].startswith(" "):
            found.add((pid, 2, "continues", ""))
        out.append((pid, "s", "b", n // per, "\n".join(["The Quiet River", "", *body, str(n // per + 1)]), False, "x"))
    return out, found


def test_book(spark):
    rows, want = book(3)
    plate = (999, "s", "b", 900, None, None, "x")
    df = spark.createDataFrame([*rows, rows[2], plate], S)
    got = {tuple(r) for r in P.findings(df).collect()}
    for kind in ("furniture", "continues", "hyphen", "misread"):
        a, b = {x for x in got if x[2] == kind}, {x for x in want if x[2] == kind}
        assert len(a & b) >= 0.95 * len(b) and len(a & b) >= 0.95 * len(a), (kind, sorted(a ^ b)[:5])


def test_paragraphs(spark):
    rows, _ = book(4, pages=5)
    got = P.paragraphs(spark.createDataFrame(rows, S)).collect()
    text = " ".join(r.text for r in got)
    assert "Quiet River" not in text and "- " not in text
    assert all(r.text[:1].isupper() for r in got) and all(r.text.endswith(".") for r in got[:3])


def test_plate_between_and_missing_page(spark):
    rows, _ = book(5)
    moved = [(p, s, b, i * 2, t, f, x) for p, s, b, i, t, f, x in rows]
    plates = [(500 + i, "s", "b", i * 2 + 1, "", True, "x") for i in range(len(rows))]
    go = lambda r: {x.page_id for x in P.findings(spark.createDataFrame(r, S)).where("line_kind = 'continues'").collect()}
    assert go(rows) == go(moved + plates)
    assert go(moved) == set()


def test_empty_and_odd(spark):
    assert P.findings(spark.createDataFrame([], S)).collect() == []
    odd = [(1, None, None, None, None, None, None), (2, None, None, 3, "  \n ", None, None), (3, "s", "b", 0, "x " * 20_000, None, None), (4, "s", "b", 1, "- 4 -", None, None)]
    assert {(r.page_id, r.line_kind) for r in P.findings(spark.createDataFrame(odd, S)).collect()} <= {(4, "furniture")}


def test_line_symbols():
    assert P.is_number("— iii —") and P.is_number("Page 3 of 20") and P.is_number("P a g e   2   o f   2 0") and P.is_number("Pag0 9 of 27") and P.is_number("-  -")
    assert not P.is_number("the crooked quarry.") and not P.is_number("Page 3 was missing.")
    assert P.close_up("T h e   S e a   7") == "The Sea 7" and P.signature("THE SEA . 7") == ("thesea", "U")
    assert P.bare('"Warncd,') == "warncd" and P.bare("unt!l") == "unt!l" and P.bare("gate!") == "gate"


def test_plates_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 2)
    rows, _ = book(5)
    go = lambda r: {x.page_id for x in P.findings(spark.createDataFrame(r, S)).where("line_kind = 'continues'").collect()}
    far = [(p, s, b, i * 8, t, f, x) for p, s, b, i, t, f, x in rows]
    plates = [(500 + 7 * i + k, "s", "b", i * 8 + 1 + k, "", True, "x") for i in range(len(rows)) for k in range(7)]
    assert go(far + plates) == go(rows) != set()
    assert go(far + plates[:3] + plates[4:]) < go(rows)


def test_long_words_and_lines(spark):
    word = "Rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz".lower()
    for bad in (word.replace("ü", "o", 1), word[:50] + "rn" + word[51:], word[:-1]):
        df = spark.createDataFrame([(word, 60), (bad, 1), ("x" * 30_000, 1), (word[:20] + "abc" + word[25:], 1)], "word string, n bigint")
        assert {(r.word, r.right) for r in P.corrections(df).collect()} == {(bad, word)}
    assert P.close_up("T h e   S e a   " * 60) .strip() == ("The Sea " * 60).strip() and P.close_up("a b " * 300) == "a b " * 300 and P.signature("lantern " * 40)[0] == "lantern" * 40


def test_paths_of_many_pages_are_those_of_one():
    r = random.Random(1)
    model = P.LineModel({("header", "t0:r2l"): 9.0, ("break", "i:>"): 20.0, ("body", "i:-"): 90.0, ("footer", "b0:number"): 8.0}, {("", "header"): 9.0, ("header", "break"): 5.0})
    pages = [[r.choice(["t0:r2l", "i:>", "i:-", "b0:number", "t1:r0l>"]) for _ in range(r.randrange(0, 12))] for _ in range(60)]
    assert model.label_all(pages) == [model.label(p) for p in pages]
    assert model.label(["t0:r2l", "i:>", "i:-", "b0:number"]) == ["header", "break", "body", "footer"]
