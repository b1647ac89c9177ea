"""The operators of the optional subpackage: edge cases, brute force, round trips and held-out accuracy."""

import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weir.llm.registry")

from weir.llm import blocks, encode, langs, mixing, mojibake, neighbours, reading, registry, repeats, residue, tokens, unify  # noqa: E402
from weir.llm.recurrent import Gru, Lstm  # noqa: E402

PROSE = ["The water board thanked residents for their help with road repair.", "Rain damaged the old canal and cut off 12 households in Lamgaun.", "Forms for school meals can be handed in at the cooperative until the 5th.", "वडा कार्यालयले आइतबार सडक मर्मतका लागि ६४ जना कर्मचारी लिने भएको छ।", "शिक्षकको सहयोगका लागि कृषि केन्द्रले धन्यवाद दियो।"]
PAGE = "id long, host string, normalized_url string, title string, text string, headings array<struct<level:int,text:string>>, extra string"


def pages(spark, texts, host="h.example"):
    return spark.createDataFrame([(k, host, f"u{k}", None, t, None, "x") for k, t in enumerate(texts)], PAGE)


def prose(n, seed=1):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(PROSE) for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("make", [lambda df: unify.unified(unify.fields_of(df)), lambda df: mojibake.repaired(unify.fields_of(df)), residue.excluded, blocks.outside, blocks.bodies, repeats.found, repeats.cleaned])
def test_empty_null_and_repeated_rows(spark, make):
    assert make(pages(spark, [])).count() == 0
    assert make(pages(spark, [None, "", "  \n ", "a", "a", "x" * 50_000])).count() >= 0


def test_residue(spark):
    texts = prose(60) + ["Dear {{ name }}, your request has been received.", "404\nPage not found\nThe page you are looking for may have moved.", "Your text goes here. Add a short description of the service.", PROSE[0] + "\nPrinters once used lorem ipsum as dummy copy; the exhibition shows 5 such sheets to farmers.\n" + PROSE[1], None, "   "]
    got = {r["id"]: r["kind"] for r in residue.excluded(pages(spark, texts)).collect()}
    assert got == {60: "placeholder", 61: "notice", 62: "filler"}


@pytest.mark.parametrize("copies", [1, 30, 300])
def test_residue_with_many_copies(spark, copies):
    notices = ["404\nPage not found\nThe page you are looking for may have moved.", "We are down for maintenance, back in 20 minutes.", "Your text goes here. Add a short description of the service."]
    varied = [f"The requested address /{a}/{b} was not found on this server." for a in ("news", "ward", "budget", "tender") for b in ("ram", "sita", "hari", "gita")]
    texts = prose(600) + notices * copies + varied * max(1, copies // 16)
    got = {r["id"] for r in residue.excluded(pages(spark, texts)).collect()}
    assert got == set(range(600, len(texts)))


# Wordings that no seed was written for. The models were compared on them once, so they are a test of general wording, not of chance.
UNSEEN = [
    "This site is being rebuilt at present. We hope to be open again next week.", "Sorry! The document could not be located on our server.", "Bad Request - Invalid URL", "The server is overloaded at the moment, please retry in a little while.", "You do not have sufficient rights to open this page.",
    "Your session is no longer valid. Kindly sign in once more.", "To use this portal, please activate JavaScript in the settings of your browser.", "Scripts are disabled. Enable scripts and load the page again.", "PHP Fatal error: Uncaught PDOException: could not find driver in /var/www/app/db.php:21",
    "Traceback (most recent call last):\n  File \"/opt/app/wsgi.py\", line 9, in <module>\nImportError: No module named 'settings'", "This domain has been registered but has no website yet. It may be for sale.", "Etiam porta sem malesuada magna mollis euismod. Vestibulum id ligula porta felis euismod semper.",
    "Write a short text about your organisation here.", "Hello {{ user }}! Your account has been created.", "Order ${order_id} was shipped to ${address}.", "Dear [Your Name],\nplease find the report attached.", "डाटाबेस उपलब्ध छैन। कृपया पछि प्रयास गर्नुहोस्।", "यो पृष्ठ अहिले मर्मतमा छ।",
    "Der Server ist zurzeit nicht erreichbar. Bitte versuchen Sie es später noch einmal.", "सर्वर अभी उपलब्ध नहीं है, कृपया बाद में आएँ।",
]
TABLES = "/root/testdata/sf0.01"


def seed_windows():
    return {w for name in residue.MODELS for w in residue.seed_windows(name)}


def test_residue_of_unseen_wording(spark):
    assert not seed_windows() & {w for t in UNSEEN for w in residue.windows(t)}
    got = {r["id"] for r in residue.excluded(pages(spark, prose(600) + UNSEEN)).collect()}
    assert min(got) >= 600 and len(got) >= 0.8 * len(UNSEEN)


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no tables")
def test_no_seed_stands_in_the_tables(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{TABLES}/crawled_documents.parquet").select("text").filter("text IS NOT NULL").collect()]
    assert seed_windows() & {w for t in texts for w in residue.windows(t)} <= {residue.HOLE}


def test_the_corpus_teaches_notices(spark):
    taught = "Kiosk mode ended, ask the front desk for a token."
    texts = ["\n".join(prose(1, seed=k)) for k in range(300)]
    df = pages(spark, texts).unionByName(pages(spark, [taught] * 5, host="i.example").withColumn("id", F.col("id") + 1000)).unionByName(pages(spark, [taught + "\nBack"] * 5, host="j.example").withColumn("id", F.col("id") + 2000))
    assert {r["id"] for r in residue.excluded(df).collect()} == {*range(1000, 1005), *range(2000, 2005)}


def test_texts_without_placeholders_are_not_searched_for_them(monkeypatch):
    assert residue.windows("Pay 5 %. {{ a }} x! <b c\n%NAME% $HOME$ &LT;me&GT;") == ["pay 0 %.", "☐ x!", "<b c", "☐ ☐ ☐"]
    monkeypatch.setattr(residue, "TOKEN", None)  # the search is what costs
    assert residue.windows("A_b @ c & d.  E 100 % f!\n g $1 ") == ["a_b @ c & d.", "e 0 % f!", "g $0"]


def many_taught(spark):
    """Pages of which 4,500 lines stand on more pages without content than the lines of one notice, of two hosts each."""
    notice = "Zulassung qwv brelm tordak\nhinwo skal prentu vokk ilra"
    listed = ["\n".join(f"{word} blatt {k}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)) for word in ("".join(random.Random(j).choices("bdfgklmnprst", k=7)) for j in range(15))]
    texts = prose(1000) + [t for t in listed for _ in range(6)] + [notice] * 4
    return texts, pages(spark, texts).withColumn("host", F.concat(F.lit("h"), F.col("id") % 2))


def test_every_window_of_the_corpus_teaches(spark):
    texts, df = many_taught(spark)
    taught = {r["window"]: r["n"] for r in residue.learned(df.filter("text IS NOT NULL").select("text", "host")).collect()}
    assert len(taught) > 4000 and all(taught[w] == 4 for w in residue.windows(texts[-1]))
    got = {r["id"] for r in residue.excluded(df).collect()}
    assert set(range(len(texts) - 4, len(texts))) <= got and not got & set(range(1000))


def test_languages_leave_out_pages_of_every_taught_notice(spark, tmp_path):
    texts, df = many_taught(spark)
    df.write.parquet(f"{tmp_path}/crawled_documents.parquet")
    df.select(F.col("id").alias("crawled_document_id"), F.lit("fr").alias("lang"), F.current_timestamp().alias("fetched_at")).write.parquet(f"{tmp_path}/page_records.parquet")  # wrong on every page
    got = {r["id"] for r in registry.p4_found(spark, str(tmp_path)).collect()}
    assert set(range(1000)) <= got and not got & set(range(len(texts) - 4, len(texts)))


def test_languages_that_are_rare_in_the_corpus_are_learned(spark):
    rare = {
        "de": "der gemeinderat hat gestern beschlossen dass die straße zum bahnhof gesperrt wird weil das wasser nach dem regen über ufer trat",
        "ne": "hamro gaunma aaja khanepani ko samasya badheko chha ra sabai manchhe haru dherai dukhi chhan tara karyalaya le kehi garena",
        "hi": "सड़क की मरम्मत के लिए गाँव में किसान और शिक्षक आए थे लेकिन बारिश से पुल टूट गया है इसलिए बच्चे स्कूल नहीं जाते हैं",
    }
    few, want = [], {}
    for language, words in rare.items():
        for _ in range(6):
            rng = random.Random(len(few))
            want[len(few)] = language
            few.append((len(few), "\n".join(" ".join(rng.choices(words.split(), k=12)) + "." for _ in range(3)), language))
    many = spark.range(1000, 31000).select("id", F.when(F.col("id") % 2 == 0, "\n".join(PROSE[:3])).otherwise("\n".join(PROSE[3:])).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("ne").alias("lang"))
    df = spark.createDataFrame(few, "id long, text string, lang string").unionByName(many)
    got = langs.stretches(df, df.select(F.col("id").alias("crawled_document_id"), "lang", F.current_timestamp().alias("fetched_at"))).filter("line_no = -1")
    assert {r["id"]: (r["lang"], r["wrong"]) for r in got.filter("id < 1000 OR wrong").collect()} == {k: (v, False) for k, v in want.items()}


def test_windows_the_filter_lets_pass_wrongly_count_as_prose(spark):
    groups = [PROSE[0].lower(), PROSE[1].lower(), "fill in {{ name }} below"]
    whole = residue.prose_counts(groups)
    assert whole.sum() and (residue.prose_counts(groups, np.array([3, 3, 3])) == 3 * whole).all()
    every = list(residue.count_batches([pa.RecordBatch.from_pydict({"text": ["\n".join(PROSE[:2])], "host": ["h"]})], np.full(residue.FILTER // 64, -1)))
    assert {r["written"] for r in every[0].to_pylist()} == {w.lower().replace("12", "0").replace("5th", "0th") for w in PROSE[:2]}
    missed = list(residue.missed_batches([pa.RecordBatch.from_pydict({"written": ["\n".join(PROSE[:1]).lower()], "n": [2]})]))[0]
    assert missed.column(1).to_numpy().sum() == 2 * (len(PROSE[0]) + 1)


def test_unify(spark):
    cases = {"café": "café", "Ｈｅａｌｔｈ": "Health", "thе соmmunіtу": "the community", "Добро": "Добро", "ofﬁce": "office", "गर्‍यो": "गर्‍यो", "👨‍👩‍👧 ❤️": "👨‍👩‍👧 ❤️", "a b​": "a b", "“It’s” – …": "“It’s” – …", "फ़": unicodedata.normalize("NFC", "फ़"), "": "", "﷐x": "x"}
    df = spark.createDataFrame([(k, "text", t) for k, t in enumerate([*cases, None])], "id long, field string, stored string")
    got = {r["id"]: (r["unified"], r["needed"]) for r in unify.unified(df).collect()}
    assert [got[k] for k in range(len(cases))] == [(v, k != v) for k, v in cases.items()] and got[len(cases)] == (None, False)


def test_mojibake_round_trip(spark):
    originals = ["“Water” – the café isn’t safe…", "वडा कार्यालयले सूचना प्रकाशन गर्यो", "Für die Straße"]
    broken = [t.encode().decode(e) for e in ("mac_roman", "cp437", "latin-1") for t in originals] + [originals[0].encode().decode("cp1251", "replace").replace("�", "")]
    texts = prose(80) + ["Добро пожаловать", "Exposé café", "isn?t it? Really??"] + broken + ["Why isn�t it", "???????? ??? ?????? ????", None, ""]
    df = spark.createDataFrame([(k, "text", t) for k, t in enumerate(texts)], "id long, field string, stored string")
    got = {r["id"]: r for r in mojibake.repaired(df).collect()}
    first = 83
    assert not any(got[k]["affected"] for k in range(first))
    for k in range(9):
        assert got[first + k]["affected"] and got[first + k]["repaired"] == originals[k % 3], broken[k]
    assert [got[first + k]["affected"] for k in (10, 11, 12, 13)] == [True, True, False, False] and not got[first + 10]["restored"]


def test_mojibake_rejects_what_information_does_not_gain(spark):
    wished = "Приятного аппетита"  # its letters spell byte sequences of another encoding
    assert mojibake.suspicious(wished) and mojibake.undo(wished)[1] is not None
    broken = "वडा कार्यालयले सूचना प्रकाशन गर्यो".encode().decode("cp1251", "replace").replace("�", "")
    df = spark.createDataFrame([(k, "text", t) for k, t in enumerate([*prose(80), wished, PROSE[0] + "\n" + wished, broken])], "id long, field string, stored string")
    got = {r["id"]: (r["affected"], r["repaired"]) for r in mojibake.repaired(df).collect()}
    assert got[80] == (False, wished) and not got[81][0] and got[82][0]


def test_repeats_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for k in range(60):
        lines = [rng.choice(PROSE) + f" {rng.random()}" for _ in range(3)]
        lines += [f"Visitors so far: {rng.randrange(999)}"] if k % 3 == 0 else []
        lines += ["  Sign in   REGISTER"] if k % 2 else ["sign in register"]
        lines += ["rare line"] if k < 4 else []
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n"]
    df = pages(spark, texts).unionByName(pages(spark, ["sign in register"] * 20, host=None).withColumn("id", F.col("id") + 1000))
    keys = {}
    for k, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if repeats.line_key(line):
                keys.setdefault(repeats.line_key(line), set()).add((k, n))
    full = sum(bool((t or "").strip()) for t in texts)
    wanted = sorted(at for places in keys.values() if len({k for k, _ in places}) >= 5 and len({k for k, _ in places}) >= 0.1 * full for at in places)
    assert sorted((r["id"], r["line_no"]) for r in repeats.found(df).collect()) == wanted


def test_bylines_that_differ_by_name_are_one_cluster(spark):
    names = ["Ram Sharma", "Sita Rai", "Kamala Gurung", "Bishnu Thapa", "Om Li", "Xavier Quintero", "Wangchuk Dorje", "Éva Zöld"]
    texts = [f"{PROSE[k % 5]} {k} {'abcdefghij'[k] * 40}\nPosted by {n} on 2078-2-{k}\n{'SIGN IN' if k % 2 else 'Sign in'} here" for k, n in enumerate(names)]
    got = [r for r in repeats.clusters(pages(spark, texts)).collect() if r["cluster_pages"] == 8]
    assert sorted((r["pages"], r["near"]) for r in got) == [(1, 8)] * 8 + [(8, 1)]
    assert {r["kept_text"] for r in repeats.cleaned(pages(spark, texts)).collect()} == {t.split("\n")[0] for t in texts}


def test_similar_lines_of_one_page_are_one_page(spark):
    rows = [f"Ward number {a} of the municipality of Lamgaun: road repair and school meals for all residents" for a in "one two six ten five four nine red blue east west north south old new big".split()]
    texts = ["\n".join(rows)] + [f"{c * 30} {PROSE[k % 5]}" for k, c in enumerate("bcdefghijklmnop")]
    df = pages(spark, texts)
    assert repeats.clusters(df).count() == 0
    assert {r["id"]: r["kept_text"] for r in repeats.cleaned(df).collect()} == dict(enumerate(texts))
    many = pages(spark, [f"{t}\n{rows[k % 6]}" for k, t in enumerate(texts[1:])])
    got = repeats.clusters(many).collect()
    assert len(got) == 6 and all(r["near"] > 1 and 2 * r["near"] <= r["cluster_pages"] <= 15 for r in got)


def test_signatures_of_similar_lines():
    rng = random.Random(4)
    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    met = pairs = 0
    for _ in range(3000):
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(95))
        k = rng.randrange(5, 90)
        y = x[:k] + "#" + x[k + 1 :] + "".join(rng.choice("abcdefgh") for _ in range(10))
        if 0.79 <= len(grams(x) & grams(y)) / len(grams(x) | grams(y)) <= 0.85:
            pairs += 1
            p, q = repeats.signatures([x, y]).view(np.uint8).reshape(2, 4, 8)
            met += any((p[i, 3 * h : 3 * h + 3] == q[i, 3 * h : 3 * h + 3]).all() for i in range(4) for h in range(2))
    assert pairs > 500 and met / pairs >= 0.99


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    for kind in ("lstm", "gru"):
        p = {}
        cell = Lstm("x", 3, 4, rng, p) if kind == "lstm" else Gru("x", 4, rng, p)
        p = {k: v.astype(np.float64) for k, v in p.items()}
        x = rng.standard_normal((5, 2, 3 if kind == "lstm" else 12))
        mask = np.ones((5, 2))
        mask[3:, 1] = 0
        g = rng.standard_normal((5, 2, 4))
        value = lambda: float((cell.forward(p, x, mask, False)[0] * g).sum())  # noqa: B023, E731
        tape, grads = cell.forward(p, x, mask, True)[1], {}
        dx = cell.backward(p, x, tape, g, grads) if kind == "lstm" else cell.backward(p, tape, g, grads)
        for table, grad in ((p["xU"], grads["xU"]), (x, dx)):
            at = tuple(rng.integers(s) for s in table.shape)
            table[at] += 1e-3
            up = value()
            table[at] -= 2e-3
            down = value()
            table[at] += 1e-3
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def site(host, seed, number=24):
    """Pages of a made-up site in made-up words, its own for everything around the bodies; with the lines outside them."""
    rng = random.Random(seed)
    word = lambda r: "".join(r.choice(["ka", "lo", "mi", "tu", "re", "sa", "no", "vi", "pa", "du"]) for _ in range(r.randrange(2, 5)))
    own = random.Random(seed + 1000)
    said = lambda n: " ".join(word(own) for _ in range(n)).capitalize()
    menu, skip, side, foot, rights = [said(1) for _ in range(8)], said(3), said(2), [said(4) + ": 12" for _ in range(3)], said(14) + "."
    rows, truth = [], []
    for k in range(number):
        title = " ".join(word(rng) for _ in range(6)).capitalize()
        sentence = lambda: " ".join(word(rng) for _ in range(rng.randrange(8, 20))).capitalize() + "."
        other = lambda: " ".join(word(rng) for _ in range(5)).capitalize()
        lines = [(skip, 1), (" | ".join(menu), 1), (f"{menu[0]} > {menu[1]} > {title[:24]}", 1), (title, 0), (sentence(), 0), (sentence() + " " + sentence(), 0), ("- " + other(), 0), (sentence(), 0), (side, 1), (other(), 1), (other(), 1), (foot[0], 1), (rights, 1), (foot[1], 1), (foot[2], 1)]
        rows.append({"id": 1000 * seed + k, "host": host, "title": title, "text": "\n".join(line for line, _ in lines), "headings": [{"level": 1, "text": title}, {"level": 3, "text": side}]})
        truth.append([y for _, y in lines])
    return rows, truth


def test_blocks_of_hosts_not_seen_in_fitting():
    labeller = blocks.fitted([r for k in range(16) for r in site(f"h{k}.example", k)[0]])
    right = lines = 0
    for k in range(50, 56):
        rows, truth = site(f"new{k}.example", k)
        read = [blocks.Page(r["text"], r["title"], r["headings"], {}) for r in rows]
        for prob, y in zip(labeller.predict(read), truth, strict=True):
            right += int(((prob >= blocks.LEVEL) == np.array(y)).sum())
            lines += len(y)
    assert right / lines >= 0.97


def test_blocks(spark):
    made = [site(f"h{k}.example", k) for k in range(8)]
    rows = [(r["id"], r["host"], str(r["id"]), r["title"], r["text"], [(h["level"], h["text"]) for h in r["headings"]], "x") for rows, _ in made for r in rows]
    df = spark.createDataFrame(rows, PAGE)
    got, wanted = {(r["id"], r["line_no"]) for r in blocks.outside(df).collect()}, {(r["id"], n) for rows, truth in made for r, y in zip(rows, truth, strict=True) for n, out in enumerate(y) if out}
    assert len(got & wanted) >= 0.98 * max(len(got), len(wanted))
    bodies = {r["id"]: r["body"] for r in blocks.bodies(df).collect()}
    assert len(bodies) == len(rows) and bodies[0].split("\n")[0] == rows[0][3]


def test_languages(spark):
    said = {"en": PROSE[0], "ne": PROSE[4], "de": "Die Genossenschaft dankte den Gästen für ihre Hilfe bei der Arbeit an der Straße.", "hi": "किसान की मदद के लिए जल बोर्ड ने धन्यवाद दिया है और सड़क की मरम्मत के लिए रुपये रखे गए हैं।"}
    names = list(said)
    texts = ["\n".join([said[names[k % 4]]] * 5) for k in range(200)] + [said["ne"] + "\n" + said["ne"] + "\n" + said["ne"] + "\n" + said["en"], None, ""]
    records = spark.createDataFrame([(k, names[k % 4] if k % 10 else None, None) for k in range(200)], "crawled_document_id long, lang string, fetched_at timestamp")
    got = {(r["id"], r["line_no"]): (r["lang"], r["wrong"]) for r in langs.stretches(pages(spark, texts), records).collect()}
    right = sum(got[(k, -1)] == (names[k % 4], k % 10 == 0) for k in range(200))
    assert right >= 190
    assert got[(200, -1)] == ("ne", True) and got[(200, 3)] == ("en", True) and (201, -1) not in got


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((40, 16))[rng.integers(0, 40, 1200)] + 0.5 * rng.standard_normal((1200, 16))).astype(np.float32)
    x[600:640] = x[:40] + 0.05 * rng.standard_normal((40, 16)).astype(np.float32)
    x[700:715] = x[50]
    rows = [(k, "m", [float(v) for v in row]) for k, row in enumerate(x)] + [(2000, "m", None), (2001, "m", []), (2002, "m", [0.0] * 16), (2003, "m", [float("nan")] * 16), (2004, "m", [1.0] * 15), (2005, "other", [1.0] * 16), (2006, "lone", [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "id long, model_name string, embedding array<float>")
    models = spark.createDataFrame([("m", 16), ("lone", 16)], "name string, dimensions int")
    near = neighbours.neighbours(vectors, models).cache()
    n = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sims = n @ n.T
    np.fill_diagonal(sims, -9)
    got = {}
    for r in near.collect():
        assert r["id"] < 2000 and r["id"] != r["neighbour"]
        got.setdefault(r["id"], []).append(r["similarity"])
    hit = sum(sum(s >= np.sort(sims[k])[-10] - 1e-9 for s in got.get(k, [])) for k in range(1200))
    assert hit / 12000 >= 0.9
    pairs = {(r["id_a"], r["id_b"]) for r in neighbours.pairs(near).collect()}
    assert {(k, 600 + k) for k in range(40)} <= pairs and all((50, k) in pairs for k in range(700, 709))


def test_exact_neighbours_of_vectors_without_structure(spark):
    x = np.random.default_rng(8).standard_normal((900, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(k, "m", [float(v) for v in row]) for k, row in enumerate(x)], "id long, model_name string, embedding array<float>")
    models = spark.createDataFrame([("m", 16)], "name string, dimensions int")
    n = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sims = n @ n.T
    np.fill_diagonal(sims, -9)
    for exact, least in ((True, 1.0), (False, 0.9)):
        got = {}
        for r in neighbours.neighbours(vectors, models, exact).collect():
            got.setdefault(r["id"], []).append(r["similarity"])
        assert sum(sum(s >= np.sort(sims[k])[-10] - 1e-9 for s in got.get(k, [])) for k in range(900)) >= least * 9000


def test_encoding_round_trip_and_reference(spark):
    rng = random.Random(3)
    odd = ["", None, " ", "\n\n  x", "<|endoftext|>", "नमस्ते संसार", "a" * 5000, "it's  we'll\t42 ½ 👩‍🌾", "  x", "<|endoftext|> y"]
    texts = odd + ["".join(rng.choice("ab क्ष é'\n 1?") for _ in range(rng.randrange(80))) for _ in range(200)] + ["same text"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encode.encoded(df).collect()}
    enc = tokens.encoder()
    assert got == {k: enc.encode_ordinary(t or "") for k, t in enumerate(texts)}
    back = {r["doc_id"]: r["decoded"] for r in encode.decoded(encode.encoded(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert encode.encoded(df.limit(0)).count() == 0


def test_encoding_holds_no_more_than_a_block(spark):
    texts = [f"the same words of every text and number {k} of them" if k % 7 else None for k in range(2600)]  # several blocks
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # blocks end within batches and go over many
        out = encode.encoded(df)
        got = {r["doc_id"]: r["ids"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    enc = tokens.encoder()
    assert got == {k: enc.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert "collect_list" not in out._jdf.queryExecution().toString()  # lists of whole blocks would lie in the heap, many at once


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", "c", None]), " ".join(rng.choice(["water", "road", "tax"]) for _ in range(rng.randrange(1, 60)))) for k in range(600)] + [(900, "a", None), (901, "a", ""), (902, "tiny", "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.2, 3), ("b", 0.3, 3), ("c", 0.2, 1), ("tiny", 0.2, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixture(docs, targets)
    by = {r["source"]: r for r in report.collect()}
    assert {s for s, r in by.items() if r["short"]} == {"tiny", "none"}
    for s in ("a", "b", "c"):
        assert 0 <= by[s]["budget"] - by[s]["reached"] < 1
    picked = used.collect()
    assert max(r["uses"] for r in picked if r["source"] == "c") == 1 and {r["source"] for r in picked} == {"a", "b", "c", "tiny"}
    assert sum(r["tokens"] * r["uses"] for r in picked if r["source"] == "b") == by["b"]["reached"]


def test_knapsack_is_exact():
    rng = np.random.default_rng(7)
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 30, 5))
        counts = rng.integers(0, 4, len(sizes))
        budget = int(rng.integers(0, 80))
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {t + s * k for t in sums for k in range(c + 1) if t + s * k <= budget}
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken <= counts).all() and int((taken * sizes).sum()) == max(sums)


def test_languages_of_words_whose_declarations_are_partly_wrong():
    rng = random.Random(12)
    made = {"en": "the ward board said that water for the town is clean and was tested", "de": "der Rat sagte dass das Wasser der Stadt sauber ist und wurde geprüft", "ne-latn": "wada karyalaya le pani ko barema suchana prakashan gareko chha", "ne": "वडा कार्यालयले पानीको बारेमा सूचना प्रकाशन गरेको छ", "hi": "वार्ड कार्यालय ने पानी के बारे में सूचना प्रकाशित की है"}
    texts = [(name, rng.choices(reading.words_of(text), k=12)) for name, text in made.items() for _ in range(60)]
    declared = [(words, rng.choice(["en", "de", "hi"]) if rng.random() < 0.1 else name[:2]) for name, words in texts]
    tongues = reading.Languages(declared)
    assert sum(tongues.of(words) == name for name, words in texts) >= 0.97 * len(texts)
    assert tongues.of([]) is None and tongues.of(["qqq"]) is None


def test_reading(spark):
    rng = random.Random(8)
    vocabulary = {g: [f"{'abcdefgh'[g]}{a}{b}" for a in "klmnp" for b in "rstvw"] for g in (1, 2, 3, 4)}
    text = lambda g: " ".join(["the", "of"] * 5 + [rng.choice(vocabulary[g] if rng.random() < 0.85 else vocabulary[rng.randrange(1, 5)]) for _ in range(60)])
    truth = {k: 1 + k % 4 for k in range(300)}
    docs = spark.createDataFrame([(k, text(g), None if k % 9 == 0 else "en") for k, g in truth.items()] + [(900, None, "en"), (901, "", "ne"), (902, "zz yy", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, "g", truth[k]) for k in range(200)] + [(0, "h", 2)], "doc_id long, grader string, grade_level int")
    got = {r["doc_id"]: r["grade_level"] for r in reading.found(docs, labels).collect()}
    assert set(got) == set(range(200, 300)) and sum(got[k] == truth[k] for k in got) >= 95
    levels = {r["doc_id"]: r["level"] for r in reading.graded(docs, labels).collect()}
    assert levels[900] is None and levels[901] is None and levels[902] is None
