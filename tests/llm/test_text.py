import random
import re

import pytest

from lutrin.llm import lookalike, personal, scans, splitting
from pyspark.sql import functions as F

CLEAN = "Règlement écrit : œuvre, m² • – ¬ λ 🏗 d'été"


def test_fold_and_suspects(spark):
    pairs = {"Règlеment": "Règlement", "ＬＳ　１２": "LS 12", "ﬁn": "fin", "Ⅸ b": "IX b", "été": "été", "a​b": "ab", "a b": "ab".replace("b", " b"), CLEAN: CLEAN, "": ""}
    df = spark.createDataFrame([(k,) for k in pairs], "v string")
    got = {r["v"]: (r["f"], r["s"]) for r in df.select("v", lookalike.fold(F.col("v")).alias("f"), lookalike.suspect(F.col("v")).alias("s")).collect()}
    assert {k: v[0] for k, v in got.items()} == pairs
    assert {k for k, v in got.items() if not v[1]} == {CLEAN, ""}


def test_classes_take_the_clean_member(spark):
    rows = [(1, "a/Été.pdf", "le mur est là"), (2, "a/Été.pdf", "le mur est là"), (3, "a/Été.pdf", "le mur est là"), (4, None, None), (5, "b/x", ""), (6, "a/été.pdf", "lе mur\nest")]
    df = spark.createDataFrame(rows, "chunk_ord long, source_path string, content string")
    got = {(r["chunk_ord"], r["field"]): r["canonical"] for r in lookalike.canonical(df, "chunk_ord", ["source_path"], "content").collect()}
    assert got == {(2, "source_path"): "a/Été.pdf", (3, "content"): "le mur est là", (6, "content"): "le mur\nest"}
    assert lookalike.canonical(df.limit(0), "chunk_ord", ["source_path"], "content").count() == 0


def test_members_come_from_all_rows_and_by_collation(spark):
    # The clean word stands only in a row that is itself suspect; the collation passes over a soft hyphen.
    rows = [(1, None, "mu\u0433 \u043eur se\u00adcteur se\u00adcteur"), (2, None, "r\u0435st\u0435 s\u0435cteur \u0441our"), (3, None, "secteur"), (4, None, "cour cour"), (5, "p", "\u043eur")]
    df = spark.createDataFrame(rows, "chunk_ord long, source_path string, content string")
    got = {r["chunk_ord"]: r["canonical"] for r in lookalike.canonical(df, "chunk_ord", ["source_path"], "content").collect()}
    assert got == {1: "mu\u0433 our se\u00adcteur se\u00adcteur", 2: "reste se\u00adcteur cour", 5: "our"}


def greedy(text, limit, overlap):
    marks, at = set(), 0
    import re

    step = limit - overlap
    for s in re.split(r"(?<=[.!?…;:])(?=\s)|(?<=\n)", text):
        parts = [s]
        if len(s) > step:
            parts = [h for w in re.split(r"(?<=\s)(?=\S)", s) for h in ([w[i : i + step] for i in range(0, len(w), step)] if len(w) > step else [w])]
        for p in parts:
            at += len(p)
            marks.add(at)
    marks = {m for m in marks if m > overlap}
    if min(marks) > limit:
        marks.add(limit)
    e, out = overlap, []
    while e < len(text):
        nxt = max(m for m in marks if e < m <= e + step)
        out.append((max(e - overlap, 0), nxt))
        e = nxt
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pieces_are_the_greedy_cuts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab c.\n" if rng.random() < 0.7 else "abcdefgh", k=rng.randint(0, 400))) for _ in range(12)] + ["é" * 300, None, "", "🏗 " * 80]
    df = spark.createDataFrame([(i % 5, t, None, i) for i, t in enumerate(texts)], "chunk_ord long, content string, section string, page int")
    rows = splitting.split(df, limit=60, overlap=12).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r["page"] == i), key=lambda r: r["piece"])
        if t is None:
            assert not mine
        elif len(t) <= 60:
            assert [(r["piece"], r["piece_text"]) for r in mine] == [(0, t)]
        else:
            assert [(r["start_pos"], r["end_pos"]) for r in mine] == greedy(t, 60, 12)
            assert all(len(r["piece_text"]) <= 60 and t[r["start_pos"] : r["end_pos"]] == r["piece_text"] for r in mine)
            assert all(a["end_pos"] - b["start_pos"] == 12 for a, b in zip(mine, mine[1:]))


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(splitting, "BLOCK", 100)
    t = " ".join(f"mot{i}." for i in range(200))
    rows = splitting.split(spark.createDataFrame([(1, t, "s", 1)], "chunk_ord long, content string, section string, page int"), limit=60, overlap=12).orderBy("piece").collect()
    assert [(r["start_pos"], r["end_pos"]) for r in rows] == greedy(t, 60, 12)


TEXT = (
    "Mme Solène de Vilpelquier habite 12 bis, rue de l'Étang Rond - 99123 Mirvaux.\nTél. +33 (0)6 39 98 12 34 ou s.v [arobase] poste [point] example. "
    "NIR : 1 84 03 99 995 655 49, passeport 17TR20242. DUPONT Jean, riverain. Permis PC 099 340 10 00041, 2,5 pour 100 @ 2025. La rue Camille Durand est longue. Me T. Brun."
)


def test_details():
    got = {(k, personal.as_value(TEXT[a:b])) for k, a, b in personal.details(TEXT)}
    assert got == {
        ("name", "Solène de Vilpelquier"), ("address", "12 bis, rue de l'Étang Rond - 99123 Mirvaux"), ("phone", "+33 (0)6 39 98 12 34"), ("email", "s.v [arobase] poste [point] example"),
        ("id_number", "1 84 03 99 995 655 49"), ("id_number", "17TR20242"), ("name", "DUPONT Jean"), ("name", "T. Brun"),
    }
    assert personal.details("") == [] == personal.details(None)


def key_of(body):
    return f"{97 - int(body.replace(' ', '').replace('2A', '19').replace('2B', '18')) % 97:02d}"


def found(text, kind):
    return [personal.as_value(text[a:b]) for k, a, b in personal.details(text) if k == kind]


@pytest.mark.parametrize("between", [" / ", " - ", ", ", " ou ", "\n"])
def test_every_number_of_a_line_is_found(between):
    numbers = ["01 23 45 67 89", "06 12 34 56 78", "+33 6 39 98 12 34", "(212) 555-0100", "01.23.45.67.80"]
    assert found(f"Tel {between.join(numbers)}.", "phone") == numbers


def test_corsican_numbers_are_found_and_replaced():
    numbers = [f"{b} {key_of(b)}" for b in ("1 84 03 2A 004 123", "2 91 11 2B 033 045")]
    text = f"NIR {numbers[0]} / {numbers[1]} et {numbers[0].replace(' ', '')}."
    assert found(text, "id_number") == [*numbers, numbers[0].replace(" ", "")]
    new = personal.replaced(text, b"k")
    assert new.count("[ID_NUMBER ") == 3 and not any(n in new for n in numbers) and new.count("2A") == 2
    assert found(text.replace(numbers[0], numbers[0][:-2] + "00"), "id_number") == [numbers[1], numbers[0].replace(" ", "")]


def test_names_outside_the_tables():
    names = ["Jean-Pierre Durand", "Marie-Claude Petit", "Nicole Durand", "JEAN-MARC LEROY", "Helene Fabre", "Roche Ginette", "Paul Richard"]
    for name in names:
        assert found(f"Observation déposée par {name}, au registre.", "name") == [name]
    assert found("Signé Paul Richard\nMairie de Valmorane", "name") == ["Paul Richard"]
    assert found("Le secteur Saint Maurice, la commune de Sainte Geneviève et Saint-Germain.", "name") == []


@pytest.mark.parametrize("street", ["rue Victor Hugo", "rue Saint Martin", "rue de la gare", "place du marché couvert", "rue de l'église", "rue d'alger", "avenue du Maréchal Jean de Lattre de Tassigny Prolongée Nord"])
def test_streets_end_where_they_end(street):
    assert found(f"Il habite 12 {street}, 75001 Valmorane, depuis mai.", "address") == [f"12 {street}, 75001 Valmorane"]


def test_streets_without_a_town():
    assert found("Vu au 3 rue de la gare hier, et au 12 rue Victor Hugo.\nJean Dupont", "address") == ["3 rue de la gare", "12 rue Victor Hugo"]
    assert found("Une règle : 4 place de stationnement par logement.", "address") == []


@pytest.mark.parametrize("text,name", [
    ("Mme Zbigniewa Kowalczyk a écrit.", "Zbigniewa Kowalczyk"), ("Observation de Fatoumata Diallo au registre.", "Fatoumata Diallo"), ("Vu par Ngozi Okafor hier.", "Ngozi Okafor"),
    ("Aleksander Nowak, riverain, demande un report.", "Aleksander Nowak"), ("Submitted by John Smith.", "John Smith"), ("Marie Anne Durand est venue.", "Marie Anne Durand"), ("Mme Oumou de Sarr conteste.", "Oumou de Sarr"),
])
def test_names_without_a_list(monkeypatch, text, name):
    assert found(text, "name") == [name]
    if "Anne" not in name:
        monkeypatch.setattr(personal, "_GIVEN", set())
        assert found(text, "name") == [name]


def test_english_addresses_and_numbers():
    assert found("I live at 221 Baker Street. Or 13 Tanner's Court, 99123 Mirvaux, call 212-555-0100.", "address") == ["221 Baker Street", "13 Tanner's Court, 99123 Mirvaux"]
    assert found("call 212-555-0100 or +1 212 555 0100.", "phone") == ["212-555-0100", "+1 212 555 0100"]
    assert found("Call me on 202.555.0116. Le lot 12-075-443, le permis 099 340 67 00086, 1.202.555.0116.", "phone") == ["202.555.0116"]
    assert found("M. Lanserquier est absent. Lanserquier A. reviendra. Plan A.", "name") == ["Lanserquier", "Lanserquier A."[:-1]]


def test_nothing_looked_back_at_is_bounded():
    local = "a" * 300 + " [point] " + "b" * 40
    assert found(f"Ecrire à {local} [arobase] poste [point] example.", "email") == [f"{local} [arobase] poste [point] example"]
    assert found("Il habite 12 rue du Grand Chemin Vert Neuf Saint Martin Haut depuis mai.", "address") == ["12 rue du Grand Chemin Vert Neuf Saint Martin Haut"]
    long = "Jean" + "-Anne" * 20
    assert found(f"Vu la rue de la{' ' * 60}Jean Vilmorin et {long} Vilmorin.", "name") == [f"{long} Vilmorin"]


def test_birth_dates():
    text = "Née le 12 mars 1980, date de naissance : 01/02/1975, born on 1980-03-12, né le 31 février 1980. Délibération du 12 mars 1980."
    assert found(text, "birth_date") == ["12 mars 1980", "01/02/1975", "1980-03-12"]
    new = {v: personal.pseudonym(b"k", "birth_date", v) for v in ("12 mars 1980", "12/03/1980", "1980-03-12", "12 March 1980")}
    assert len({personal._day(x) for x in new.values()}) == 1 and personal._day(new["12 mars 1980"]) != personal._day("12 mars 1980")
    assert re.fullmatch(r"\d+(er)? \w+ \d{4}", new["12 mars 1980"]) and re.fullmatch(r"\d{4}-\d\d-\d\d", new["1980-03-12"]) and re.fullmatch(r"\d\d/\d\d/\d{4}", new["12/03/1980"])


def test_pseudonyms_keep_format_and_links():
    key = b"k"
    f = [personal.feistel(key, "x", f"{i:03d}") for i in range(1000)]
    assert sorted(f) == [f"{i:03d}" for i in range(1000)] and f != sorted(f)
    assert sorted(personal.within(key, "y", i, 26) for i in range(26)) == list(range(26)) and sorted(personal.feistel(key, "z", str(i)) for i in range(10)) == list("0123456789")
    a, b = personal.pseudonym(key, "phone", "06 39 98 12 34"), personal.pseudonym(key, "phone", "+33 6.39.98.12.34")
    assert len(a) == 14 and a[:2] == "06" and "".join(c for c in a if c.isdigit())[-8:] == "".join(c for c in b if c.isdigit())[-8:]
    n = personal.pseudonym(key, "id_number", "1 84 03 99 995 655 49")
    assert personal._nir_ok(personal._NIR.fullmatch(n).groups()) and n != "1 84 03 99 995 655 49"
    passports = {personal.pseudonym(key, "id_number", f"17{chr(65 + i)}{chr(65 + j)}20242") for i in range(26) for j in range(26)}
    assert len(passports) == 676 and all(re.fullmatch(r"\d\d[A-Z]{2}\d{5}", x) for x in passports)
    assert personal.pseudonym(key, "name", "A B") == personal.pseudonym(key, "name", "A B") and len(personal.pseudonym(key, "name", "A B")) == 16


def test_find_and_replace_tables(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (1, TEXT, "x")], "doc_id long, text string, kind string")
    found = personal.find(df)
    assert found.count() == 16
    rows = personal.replace(df, "k").collect()
    assert [r["text"] for r in rows if r["doc_id"] > 1] == [None, ""]
    new = rows[0]["text"]
    assert "Vilpelquier" not in new and "[NAME " in new and "habite [ADDRESS" in new and "La rue Camille Durand" in new
    assert personal.find(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        personal.replace(df, "")
    clash = df.select(F.col("doc_id").alias("id"), F.col("text").alias("word"), F.lit(1).alias("lex"), "kind")
    for most in (None, 0):
        assert personal.find(clash, "id", "word", most).count() == 16 and personal.replace(clash, "k", "id", "word", most).count() == 4


def test_names_the_collection_shows(spark, monkeypatch):
    """Given names without a list, by the surnames they stand beside; the same when the lexicon is a joined table."""
    monkeypatch.setattr(personal, "_GIVEN", set())
    rows = [(1, "M. Kowal conteste. Mme Brisson aussi. Vu A. Tarlet."), (2, "Oulya Kowal signe."), (3, "BRISSON Oulya\nle reste"), (4, "le hameau Vieux Canal, le Vieux Canal et l'avis de Vieux Canal"),
            (5, "Zorbin Tarlet, Oulya Marchetti : la rue Oulya Perrin"), (6, "Le maire et le Maire Kowal, un maire"), (None, "Oulya\nGarcin vient"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, "Kowal"), (1, "Brisson"), (1, "A. Tarlet"), (2, "Oulya Kowal"), (3, "BRISSON Oulya"), (5, "Zorbin Tarlet"), (5, "Oulya Marchetti"), (None, "Oulya Garcin")}
    for most in (None, 0):
        got = {(r["doc_id"], r["value"]) for r in personal.find(df, most_words=most).where("kind = 'name'").collect()}
        assert got == want
        assert not any(x in r["text"] for r in personal.replace(df, "k", most_words=most).where("text IS NOT NULL").collect() for x in ("Marchetti", "Tarlet", "Garcin"))


def body(i):
    return f"Le règlement de la commune fixe la hauteur des constructions numéro {i} dans le secteur et la marge du terrain."


def pages():
    """Pages of a scanned file with header, page number, broken words and misread characters."""
    rows = []
    for i in range(1, 41):
        lines = ["Plan local de Valmorane", body(i), body(i + 1), "", body(i + 2), "la cons-", "truction du marché-", "vieux et le procès-", "verbal.", "secteur", f"Page {i} sur 40"]
        rows.append(("doc_pages", i, "f.pdf", i, "\n".join(lines)))
    rows += [("chunks", 1, "f.pdf", None, "Plan local de Valmorane\nLa hauteur des constructi0ns et la rnarge du secfeur numéro 7\nfixe la sur¬\nface."), ("chunks", 2, "g.pdf", None, "le marché-vieux et le procès-verbal, la construction, " * 20), ("chunks", 3, "g.pdf", None, None), ("chunks", 4, None, None, "")]
    return rows


ROWS = "origin string, row_id long, path string, page int, text string"


def test_noise_of_pages(spark):
    noise = scans.Noise(spark.createDataFrame(pages(), ROWS))
    found = {tuple(r) for r in noise.found().collect()}
    for i in (1, 17, 40):
        assert {(n, k) for o, r, n, k in found if (o, r) == ("doc_pages", i)} == {(1, "furniture"), (11, "furniture"), (6, "hyphen")}
    assert {(n, k) for o, r, n, k in found if (o, r) == ("chunks", 1)} == {(1, "furniture"), (2, "glyph"), (3, "hyphen")}
    assert not {x for x in found if x[0] == "chunks" and x[1] > 1}
    paras = {r["row_id"]: r["text"] for r in noise.paragraphs().where("origin = 'chunks'").collect()}
    assert paras[1] == "La hauteur des constructions et la marge du secteur numéro 7 fixe la surface."
    flow = [r["text"] for r in noise.paragraphs().where("origin = 'doc_pages'").collect()]
    assert any("la construction du marché-vieux et le procès-verbal. secteur Le règlement" in t for t in flow)


WORDS = "règlement commune hauteur construction secteur terrain marge clôture parcelle toiture façade logement stationnement desserte réseau voirie trottoir implantation limite surface emprise".split()


@pytest.mark.parametrize("files,pages", [(3, 4), (12, 10)])
def test_repaired_text_is_the_clean_original(spark, files, pages):
    """Clean paragraphs, wrapped, broken at line ends by marks and hyphens, misread and set under headers with page
    numbers, some over a page's end and delivered twice: the originals come back, in their case."""
    rng, rows, want, row = random.Random(files), [], [], 0
    for f in range(files):
        clean = []
        for _ in range(pages * 2):
            ws = [rng.choice(WORDS) for _ in range(rng.randint(25, 45))]
            ws[0], ws[5], ws[9] = ws[0].capitalize(), ws[5].upper(), "procès-verbal"
            clean.append(" ".join(ws) + ".")
        want += clean
        lines = []
        for para in clean:
            line = ""
            for w in para.split(" "):
                if len(line) + len(w) < 60:
                    line = f"{line} {w}".strip()
                    continue
                if rng.random() < 0.5 and w.isalpha() and len(w) > 7:
                    lines.append(f"{line} {w[:4]}{rng.choice(['-', chr(0xAC), chr(0xAD)])}")
                    line = w[4:]
                else:
                    lines.append(line)
                    line = w
            lines += [line, ""]

        def noisy(x):
            words = x.split(" ")
            for i, w in enumerate(words):
                if rng.random() < 0.03 and w.isalpha() and len(w) > 5:
                    at = w.lower().find("o", 1, len(w) - 1) if rng.random() < 0.5 else w.lower().find("m", 1, len(w) - 1)
                    if at > 0:
                        new = {"o": "0", "m": "rn"}[w[at].lower()]
                        words[i] = w[:at] + (new.upper() if w.isupper() else new) + w[at + 1 :]
            return " ".join(words)

        per = -(-len(lines) // pages)
        for n in range(pages):
            body = "\n".join(noisy(x) for x in lines[n * per : (n + 1) * per]).strip("\n")
            for _ in range(2 if rng.random() < 0.1 else 1):
                row += 1
                rows.append(("doc_pages", row, f"f{f}.pdf", n + 1, f"Plan local de la commune de Valmorane, révision générale numéro deux du dossier arrêté\n{body}\nPage {n + 1} sur {pages}"))
    noise = scans.Noise(spark.createDataFrame(rows, ROWS))
    got = [r["text"] for r in noise.paragraphs().collect()]
    assert len(got) == len(want)
    right = len(set(got) & set(want))
    assert right >= 0.97 * len(want), [g for g in got if g not in want][:5]
    assert "".join(sorted("".join(got).replace(" ", ""))) == "".join(sorted("".join(want).replace(" ", ""))) or right < len(want)


def test_caps_are_gone(spark):
    """A long header, a page number far from the left margin, a number far above the page's, a long word's beginning."""
    long = "Plan local d'urbanisme de la commune de Valmorane et de ses hameaux, pièces écrites et documents graphiques"
    word = "anti" * 9 + "construction"
    rows = []
    for i in range(1, 41):
        rows.append(("doc_pages", i, f"f{i // 8}.pdf", i, f"{long}\n{body(i)}\nle {word} est\n{body(i + 1)}\nle {word[:30]}-" + f"\n{' ' * 40}Page {i + 31} sur 90"))
    found = {tuple(r) for r in scans.Noise(spark.createDataFrame(rows, ROWS)).found().collect()}
    for i in (1, 17, 40):
        assert {(n, k) for o, r, n, k in found if r == i} == {(1, "furniture"), (6, "furniture"), (5, "hyphen")}
    assert scans._page_number(["LS 12-345 AB 0123", "131"], [0, 1], 1, 100, lambda x: False, {31}) and not scans._page_number(["LS 12-345 AB 0123", "131"], [0, 1], 1, 100, lambda x: False, {5})


def test_neighbours_choose_between_readings(spark):
    """Two true words that one misread form may stand for, and one that is no eighth as frequent as its true form."""
    rows = [("chunks", i, None, None, "la fosse est comblée puis la casse arrive\nle mur de clôture et le bois coupé") for i in range(30)]
    rows += [("chunks", 100 + i, None, None, "le bon foin sec et le bon coin sec") for i in range(9)]
    rows += [("chunks", 200 + i, None, None, "un toit rouge en tuile") for i in range(5)] + [("chunks", 300 + i, None, None, "un tolt rouge en tuile") for i in range(3)]
    rows += [("chunks", 400 + i, None, None, "la mare verte dort") for i in range(5)] + [("chunks", 500 + i, None, None, "son maro tlent") for i in range(3)]
    rows += [("chunks", 900, None, None, "on dit que la fo5se est comblée"), ("chunks", 901, None, None, "le mois pont\nle bon mols pluvieux"), ("chunks", 902, None, None, "les mots vus"), ("chunks", 903, None, None, "un m0ts pluvieux")]
    rows += [("chunks", 1000 + i, None, None, "un mois pluvieux") for i in range(9)] + [("chunks", 1100 + i, None, None, "les mots vus hier") for i in range(9)]
    noise = scans.Noise(spark.createDataFrame(rows, ROWS))
    fixes = {(r["row_id"], r["read"]): r["true"] for r in noise.fixes().collect()}
    assert fixes[900, "fo5se"] == "fosse" and fixes[903, "m0ts"] in ("mots", "mois")
    assert fixes[901, "mols"] == "mois"  # before "pluvieux" stands mois, not mots
    assert all(fixes[300 + i, "tolt"] == "toit" for i in range(3)) and not any(k[1] in ("mots", "mois", "toit", "maro") for k in fixes)


def test_words_keep_their_case():
    assert [scans.restored(*x) for x in (("Règ1ement", "règlement"), ("RÈG1EMENT", "règlement"), ("rnarge", "marge"), ("RNARGE", "marge"), ("com1e", "comte"))] == ["Règlement", "RÈGLEMENT", "marge", "MARGE", "comte"]
    assert scans.likely("p1an") == "plan" and scans.likely("R0UTE") == "ROUTE" and scans.likely("A1") == "A1"
    both = [{"kind": "hyphen", "line_no": 1, "next_line": 2, "read": None, "true": None}, {"kind": "word", "line_no": 1, "next_line": 2, "read": "hautcur", "true": "hauteur"}]
    assert scans.reflowed("la hau-\ntcur, p1an 3O,5 m\n\nLS 12-345 AB 0123\nsuite", both) == [("la hauteur, plan 30,5 m", False, False), ("LS 12-345 AB 0123", False, True), ("suite", False, False)]
    assert scans.reflowed("x", [{"kind": "twice", "line_no": None, "next_line": None, "read": None, "true": None}]) == [] == scans.reflowed("", [])


def test_noise_of_empty_table(spark):
    noise = scans.Noise(spark.createDataFrame([], ROWS))
    assert noise.found().count() == 0 and noise.paragraphs().count() == 0


def test_misread_positions():
    assert scans.misread("rnarge", "marge") == [0] and scans.misread("secfeur", "secteur") == [3] and scans.misread("mur", "mur") is None and scans.misread("mots", "mur") is None
    assert scans.skeleton("constriiction") == scans.skeleton("construction") and scans.mask("Secteur 12 – Notice") == scans.mask("SECTEUR 3 – NOTICE")


def test_many_headers_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(pages(), ROWS)
    want = {tuple(r) for r in scans.Noise(df).found().collect()}
    monkeypatch.setattr(scans, "MOST_HEADERS", 0)
    assert {tuple(r) for r in scans.Noise(df).found().collect()} == want
