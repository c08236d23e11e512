"""Operators for training corpora against brute force and defined cases."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("corpuslens.llm")

from pyspark.sql import functions as F  # noqa: E402

from corpuslens.llm import cooccurrence, main_content, mixing, names, repeated_lines, residue, survivors, tokenizing, truncation  # noqa: E402

ARTICLE = "id bigint, url string, title string, source string, author string, full_text string, first_paragraph string, summary string, word_count int, duplicate_of bigint, published_date string, language string, key string, line string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def articles(spark, *given):
    """Articles with columns that clash with inner names; what is not given is null."""
    names_ = [c.split()[0] for c in ARTICLE.split(", ")]
    return spark.createDataFrame([tuple(g.get(n) for n in names_) for g in given], ARTICLE)


def feeds(spark, *given):
    return spark.createDataFrame(list(given), "name string, priority int")


# --- items that appear together


def brute_pairs(baskets, least):
    sets = {}
    for b, i in baskets:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n = len(sets)
    c = {}
    for s in sets.values():
        for p in itertools.combinations(sorted(s), 2):
            c[p] = c.get(p, 0) + 1
    one = {}
    for s in sets.values():
        for i in s:
            one[i] = one.get(i, 0) + 1
    return {(a, b, n, one[a], one[b], k) for (a, b), k in c.items() if k >= least}


def test_associations_equal_brute_force_with_nulls_repeats_and_a_hot_basket(spark):
    r = random.Random(5)
    data = [(r.randrange(60), r.choice("abcdefgh")) for _ in range(400)] + [(1, "a")] * 300 + [(None, "a"), (2, None), (None, None)]
    df = spark.createDataFrame(data, "basket bigint, item string").withColumn("items", F.lit(1)).withColumn("weight", F.lit(2))
    got = rows(cooccurrence.associations(df, "basket", "item", 4, 0.001).select("item_a", "item_b", "n", "a", "b", "c"))
    assert got == brute_pairs(data, 4)


def test_associations_of_an_empty_table(spark):
    assert cooccurrence.associations(spark.createDataFrame([], "b bigint, i string"), "b", "i").count() == 0


def test_tags_are_compared_lower_cased_and_trimmed(spark):
    data = [(i, t) for i in range(5) for t in (" A:x\t", "a:X", "b:y", "", None)]
    got = cooccurrence.tag_pairs(spark.createDataFrame(data, "article_id bigint, tag string")).collect()
    assert [(g["item_a"], g["item_b"], g["c"]) for g in got] == [("a:x", "b:y", 5)]


# --- names


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Rüdiger Züstenhofsen", "Ruediger Zuestenhofsen"), ("Petra Maierhofer", "MAIERHOFER, PETRA"), ("Petra Maierhofer", "P. Maierhofer"), ("Petra Maierhofer", "Von Dr. Petra Maierhofer (pm)"), ("Petra Maierhofer", "petra.maierhofer"), ("Petra Maierhofer", "Pertra Maierhofer"),
        ("Florian Büngerhof", "Flo Büngerhof"), ("Netzwerk Freie Szene Talheim", "NFS Talheim"), ("Kulturdienst Auental (kda)", "KDA"), ("Agentur Silberfeder", "Ag. Silberfeder"), ("Theaterbund Mirlau e.V.", "Theater-Bund Mirlau"), ("Jakob Weber-Quint", "Jakob Weber"), ("Petra Maierhofer", "Petra  Maierhofer "),
    ],
)
def test_spellings_of_one_name(spark, a, b):
    df = spark.createDataFrame([(x,) for x in (a, b, "Ulrike Ganzanders", None, "")], "author string")
    assert rows(names.variant_pairs(df, "author")) == {tuple(sorted((a, b)))}


def test_names_that_must_not_meet(spark):
    values = ["Ulrike Grürtal", "Uwe Grürtal", "U. Grürtal", "Petra Maierhofer & Uwe Grürtal", "Redaktion", "Kulturredaktion", "Petra Sommerfeld", "Barbara Sommerfeld", "", None, " "]
    assert names.variant_pairs(spark.createDataFrame([(x,) for x in values], "author string"), "author").count() == 0


def test_a_merged_profile_enters_blocking_again(spark):
    values = ["Kulturdienst Auental", "KULTURDIENST AUENTAL (KDA)", "KDA", "kulturdienst-auental"]
    e = names.resolve_names(spark.createDataFrame([(x,) for x in values], "author string"), "author")
    assert e.select("entity").distinct().count() == 1 and e.count() == 4


# --- lines repeated within a source


def brute_lines(docs):
    n, k = {}, {}
    for _, s, t in docs:
        if s is None:
            continue
        n[s] = n.get(s, 0) + 1
        for x in {" ".join(x.replace("﻿", " ").split()) for x in (t or "").split("\n")} - {""}:
            k[s, x] = k.get((s, x), 0) + 1
    return {x for x, c in k.items() if c >= 5 and c * 20 >= n[x[0]]}


def test_repeated_lines_equal_brute_force_however_many_deltas(spark):
    r = random.Random(2)
    lines = ["  Alle Rechte ", "Alle\xa0Rechte", "eins", "zwei", "", "\t", "drei vier\r"]
    docs = [(i, r.choice(["A", "B", None]), r.choice([None, "", "\n".join(r.choice(lines) for _ in range(6))])) for i in range(150)] + [(900 + i, "B", f"nur {i}") for i in range(90)]
    df = spark.createDataFrame(docs, "id bigint, source string, text string").withColumn("line", F.lit("x")).withColumn("h1", F.lit(1))
    for k in (1, 2, 3):
        assert rows(repeated_lines.repeated_lines(df, k)) == brute_lines(docs)
    keep = brute_lines(docs)
    clean = {r["id"]: r["text"] for r in repeated_lines.without_repeated_lines(df).collect()}
    for i, s, t in docs:
        want = t if t is None else "\n".join(x for x in t.split("\n") if (s, " ".join(x.split())) not in keep)
        assert clean[i] == want


def test_crossings_name_new_and_lapsed_lines(spark):
    docs = spark.createDataFrame([(i, "A", "x") for i in range(5)], "id bigint, source string, text string")
    more = spark.createDataFrame([(100 + i, "A", "y") for i in range(200)], "id bigint, source string, text string")
    one = repeated_lines.merge(None, repeated_lines.delta(docs))
    before = repeated_lines.over_threshold(one)
    after = repeated_lines.over_threshold(repeated_lines.merge(one, repeated_lines.delta(more)))
    new, gone = repeated_lines.crossings(before, after)
    assert (before.count(), new.count(), gone.count()) == (1, 1, 1)


def test_deltas_rebuild_only_touched_documents_and_equal_one_shot(spark, tmp_path):
    r = random.Random(6)
    docs = [(i, r.choice("AB"), "\n".join(r.choice(["eins", "zwei", f"nur {i}", "drei", f"auch {i}"]) for _ in range(4))) for i in range(120)]
    docs += [(500 + i, "C", "vier" if i < 6 else f"allein {i}") for i in range(200)] + [(900, None, "eins"), (901, "A", None)]
    df = spark.createDataFrame(docs, "id bigint, source string, text string")
    state = repeated_lines.LineState(spark, f"file://{tmp_path}/state")
    part = lambda k: F.col("id") % 3 == k
    for k in range(2):
        state.advance(df.where(part(k)), df.where("id % 3 <= " + str(k)))
    again = repeated_lines.LineState(spark, f"file://{tmp_path}/state")
    assert again.versions() == 2
    last = again.advance(df.where(part(2)), df)
    assert 0 < last.count() < df.count()
    kept = {x["id"]: x["text"] for x in again.rebuilt().collect()}
    keep = brute_lines(docs)
    for i, s, t in docs:
        want = t if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in keep)
        assert kept.get(i, t) == want
    one = {x["id"]: x["text"] for x in repeated_lines.without_repeated_lines(df, 1).collect()}
    assert {x["id"]: x["text"] for x in repeated_lines.without_repeated_lines(df).collect()} == one


# --- main content


PAGE = "Startseite\nKultur | Bühne | Film\nSie sind hier: Startseite › Kultur › Nachtlicht\nDie Regie zeigt den Stoff ohne Pause, und das Haus folgt ihr gern.\n\nLesen Sie auch: Ein anderer Titel\nFazit\nMit: Anna Arndt, Bernd Bull\nDas Ensemble trägt den Abend, mit wenig Geld und viel Papier.\nWarum gerade jetzt?\n12 Kommentare\nMeistgelesen\n1. Der eine Text\n2. Der andere Text\nImpressum\n© Bote"


def test_page_lines_are_told_from_own_lines(spark):
    def page(i):
        own = f"Die Bühne {i} zeigt den Stoff ohne Pause, und das Haus folgt ihr gern."
        if i != 1:
            return f"Startseite\nKultur | Bühne | Film\nSie sind hier: Startseite › Kultur › Werk {i}\n{own}\nLesen Sie auch: Titel {chr(97 + i)}{i}\nDer {i}. Abend hat Kraft und Witz, wie man hört.\n{i + 20} Kommentare\nMeistgelesen\nText a{i} im Haus\nText b{i} im Haus\nImpressum\n© Bote"
        return PAGE

    notice = "Wir und unsere Partner speichern auf Ihrem Gerät, was wir brauchen, und Sie willigen darin ein. " * 20
    corpus = [{"id": i, "source": "Bote", "full_text": page(i) + (f"\n{notice}" if i > 9 else "")} for i in range(2, 42)]
    a = articles(spark, {"id": 1, "source": "Bote", "full_text": PAGE, "first_paragraph": "Startseite\nDie Regie zeigt den Stoff ohne Pause, und das Haus folgt ihr gern."}, {"id": 102}, {"id": 103, "full_text": "", "first_paragraph": " \n "}, {"id": 104, "full_text": "Kurz."}, *corpus)
    got = {(r["id"], r["field"]): (sorted(r["page_lines"]), r["text"]) for r in main_content.main_content(a).collect()}
    assert got[1, "full_text"][0] == [1, 2, 3, 6, 11, 12, 13, 14, 15, 16]
    assert got[1, "first_paragraph"] == ([1], "Die Regie zeigt den Stoff ohne Pause, und das Haus folgt ihr gern.")
    assert got[103, "full_text"] == ([], "") and got[104, "full_text"] == ([], "Kurz.") and (102, "full_text") not in got
    assert got[20, "full_text"][0] == [1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13]
    flags = {(r["key"], r["field"], r["line_no"]): r["own"] for r in main_content.scored_lines(a.unionByName(a)).collect()}
    assert all(flags[k, f, n] is False for (k, f), (pages, _) in got.items() for n in pages)


def test_lists_of_links_go_and_subheads_stay_without_any_word_list(spark):
    text = lambda i: f"Im Haus {i} beginnt der Abend, und alle sehen zu.\nZwischenruf {chr(97 + i % 26)}{chr(97 + i // 26)}\nNoch ein Satz steht hier, er ist von {i} Leuten gelesen.\nblork zum flirp\nerster Eintrag {i}\nzweiter Eintrag {i}\ndritter Eintrag {i}"
    a = articles(spark, *[{"id": i, "source": f"S{i}", "full_text": text(i)} for i in range(30)])
    for r in main_content.main_content(a, ("full_text",)).collect():
        assert sorted(r["page_lines"]) == [4, 5, 6, 7]


# --- truncation


def test_broken_off_texts(spark):
    full = ["Die Regie zeigt den Stoff ohne Pause.", "Das Haus erzählt den Text mit wenig Geld.", "Die Regie zeigt den Stoff mit wenig Geld laut Dr. Wenk vom Haus.", "Das Haus erzählt den Stoff ohne Pause."]
    given = [{"id": i, "source": "A", "title": f"Titel {i}", "full_text": f"Wort{i} beginnt den Abend. " + " ".join(full[(i + j) % 4] for j in range(3)) + " Man wird sehen ..." * (i % 5 == 0)} for i in range(60)]
    cuts = {100: "Das Haus erzählt den Text mit wenig Geld. Die Regie zeigt den", 101: "Das Haus erzählt den Text mit wenig Geld. Die Regie ze", 102: "Die Regie zeigt den Stoff ohne Pause. Das Haus erzählt …", 103: "Die Regie zeigt den Stoff ohne Pause. Das Haus erzä�", 104: "Die Regie zeigt den Stoff ohne Pause. Das Haus erzählt den Text laut Dr."}
    whole = {200: "Die Regie zeigt den Stoff ohne Pause.", 201: "Das Haus erzählt den Stoff ohne Pause. Man wird sehen ...", 202: "Das Haus erzählt den Text mit wenig Geld. (red)"}
    given += [{"id": i, "source": "A", "title": "T", "full_text": t} for i, t in (cuts | whole).items()] + [{"id": 300, "title": "Das Haus erzählt den", "summary": "Das Haus erzählt den"}, {"id": 301}, {"id": 302, "full_text": " \n"}]
    got = {(r["id"], r["field"]) for r in truncation.truncated_fields(articles(spark, *given)).where("truncated").collect()}
    assert got == {(i, "full_text") for i in cuts}


@pytest.mark.parametrize("copies", [3, 1000])
def test_copies_of_a_cut_text_do_not_vouch_for_one_another(spark, copies):
    whole = [{"id": i, "source": "A", "title": f"Titel {i}", "full_text": f"Wort{i} beginnt den Abend. Die Regie zeigt den Stoff ohne Pause."} for i in range(30)]
    text = "Das Haus erzählt den Text mit wenig Geld. Am Ende trägt das Ensemble einen seltsam leuchtenden"
    cut = [{"id": 1000 + i, "source": f"B{i // 3}", "title": "T", "full_text": text, "summary": text.split(". ")[1] if i % 2 else None} for i in range(copies)]
    got = {(r["id"], r["field"]) for r in truncation.truncated_fields(articles(spark, *whole, *cut)).where("truncated").collect()}
    assert got == {(r["id"], f) for r in cut for f in ("full_text", "summary") if r[f]}


# --- survivors


def test_survivors_of_chains_loops_stars_and_dangling_links(spark):
    given = [{"id": 1, "source": "lo", "word_count": 9}, {"id": 2, "source": "hi", "duplicate_of": 1}, {"id": 3, "duplicate_of": 2, "source": "hi", "word_count": 5}, {"id": 10, "duplicate_of": 11}, {"id": 11, "duplicate_of": 10}, {"id": 20, "duplicate_of": 999}, {"id": 30, "duplicate_of": 30}, *[{"id": 40 + i, "duplicate_of": 40, "word_count": 7} for i in range(30)]]
    got = rows(survivors.survivors(articles(spark, *given), feeds(spark, ("hi", 9), ("lo", 1), (None, 50))))
    assert got == {(1, 3), (10, 10), (40, 40)}
    best = {r["group_id"]: r for r in survivors.merged_records(articles(spark, *given), feeds(spark, ("hi", 9)), ("title", "author")).collect()}
    assert best[1]["n_members"] == 3 and best[40]["n_members"] == 30


# --- encoding


def test_ids_equal_plain_encoding_also_of_long_unsplit_texts(spark):
    r = random.Random(1)
    bits = ["a", "b", "'s", "'", "!", "  ", "\n", "ä", "日本", "42", " the", "don't", "🎭", "x" * 40, "<|endoftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(300))) for _ in range(60)] + ["a" * 3000, "日" * 1500, " " * 999, "1" * 777, None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit(0)).withColumn("ids", F.lit(1))
    got = {x["doc_id"]: x["ids"] for x in tokenizing.token_ids(df, leaf=64).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == tokenizing.encode(t or "", tokenizing.VOCABULARY)
        assert tokenizing.encoder(tokenizing.VOCABULARY).decode(got[i]) == (t or "")


# --- mixing


def test_permutation_and_counts_are_exact():
    for n in (1, 2, 7, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3)) == list(range(n))
    quota = np.array([40, 7, 0, 53])
    taken = [mixing.shard_counts(quota, i, 7, 16, 5) for i in range(7)]
    assert (sum(c for _, c in taken) == quota).all()
    for s in range(4):
        spans = sorted((int(a[s]), int(a[s] + c[s])) for a, c in taken if c[s])
        assert [x for x, _ in spans] == [0, *[y for _, y in spans[:-1]]][: len(spans)]


def test_mix_reaches_its_shares_within_the_caps(spark):
    docs = [(i, "big" if i % 10 else "small", "Das Haus zeigt den Stoff ohne Pause. " * (1 + i % 5)) for i in range(300)] + [(900, None, "x"), (901, "unwanted", "y"), (902, "big", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, plan = mixing.mixture(d, t, block=32, slots=8)
    m = mix.select("source", "block_no", "n_tokens", "ids").collect()
    uses = {}
    for r in m:
        assert r["n_tokens"] == len(r["ids"])
        uses[r["source"], r["block_no"]] = uses.get((r["source"], r["block_no"]), 0) + 1
    assert max(v for (s, _), v in uses.items() if s == "small") <= 3 and max(v for (s, _), v in uses.items() if s == "big") == 1
    got = {r["source"]: r["reached_share"] for r in mixing.shares(mix, plan).collect()}
    assert abs(got["big"] - 5 / 9) < 0.02 and abs(got["small"] - 4 / 9) < 0.02 and got["none"] == 0
    over = mixing.plan_mix([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 1000, "b": 100}, 10, 800)
    assert [s.quota for s in over] == [70, 10]


# --- residue


@pytest.mark.parametrize("line", ["Ort: {{ regie }}", "${site.name}", "Titel: <%= title %>", "[datum HIER EINFÜGEN]", "[Your Name Here]", "Dies ist ein Blindtext.", "404 – Seite nicht gefunden", "502: der Artikel hat die Anfrage abgelehnt", "HTTP Error 502 - Bad Gateway", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "This site requires scripts and cookies.", "TEXT TEXT TEXT", "bla bla bla", "Ceci est un faux texte", "Ort: {{ " + "x" * 60 + " }}", "<%= " + "x" * 60 + " %>", "{% if " + "x" * 2000 + " %}"])
def test_trusted_signs(line):
    assert residue.sign_of(line)


@pytest.mark.parametrize("line", ["Auf der Leinwand erscheint „{{name}}“, bis die Souffleuse den Namen eingibt.", "In „Fehler 404“ führt jede Tür auf dieselbe Meldung: Seite nicht gefunden.", "Der Chor singt „lorem, lorem“ wie ein Wiegenlied.", "Zugriff verweigert, heißt es an der Garderobe.", "Wer JavaScript aktivieren wollte, brauchte Geduld.", "Die Auslastung stieg um 5 % auf 9 %.", "[Name von der Redaktion geändert] Die Zeugin erinnert sich.", "<|endoftext|> </s>", "(Platzhalter für ein Leben)", "Am Abend kamen 404 Gäste.", "Sie schrieb Skripte für die Bühne, ohne Browser und ohne Pause."])
def test_texts_that_only_speak_of_residue(line):
    assert residue.sign_of(line) is None


def test_labels_spread_over_near_duplicates_only(spark):
    notice = "Der angeforderte Beitrag liegt hinter einer Wartungsseite und kommt bald wieder, bitte haben Sie bis dahin noch etwas Geduld mit unserem kleinen Team"
    trusted = "Dies ist ein Blindtext " + notice
    docs = [(1, trusted), (2, "Das Haus zeigt den Stoff ohne Pause."), (3, None), (4, ""), (5, "heute " + trusted), (6, "Das Haus zeigt {{titel}} den Stoff ohne Pause und mit viel Papier, während die Regie das Tempo der Figuren streift und der Chor schweigt."), (7, "Das Haus zeigt den Stoff ohne Pause und mit viel Papier, während die Regie das Tempo der Figuren streift und der Chor schweigt."), (8, trusted)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("line", F.lit("x")).withColumn("kind", F.lit("y"))
    got = {r["doc_id"]: r["by"] for r in residue.residue_documents(df).collect()}
    assert got == {1: "sign", 5: "near", 6: "sign", 8: "sign"}
    assert {r["doc_id"] for r in residue.without_residue(df).collect()} == {2, 3, 4, 7}


def test_wording_that_no_sign_knows_is_reached_and_content_is_not(spark):
    r = random.Random(4)
    seeds = ["404 Not Found", "Fehler 502: Zugriff verweigert", "Dies ist ein Blindtext."]
    unknown = ["Der Kasten klemmt gerade.", "Oh weh, hier fehlt etwas.", "Morgen sind wir zurück.", "Bitte hier das Eigentliche hinstellen.", "Die Leitung schweigt.", "Nichts zu holen heute."]
    docs = [(i, "\n".join(r.sample(seeds + unknown, 2))) for i in range(120)] + [(200 + k, u) for k, u in enumerate(unknown)]
    content = [(1000 + i, f"Titel {chr(97 + i % 7)} am Abend\nDas Haus {chr(97 + i % 26)}{chr(97 + i // 26)} zeigt den Stoff ohne Pause.\nDie Regie streift Wort{i}a und Wort{i}b im Saal.") for i in range(150)]
    content += [(2000, "Titel a am Abend\n404 Not Found"), (2001, "Eine Zeile steht hier allein.\nDer Kasten klemmt gerade.")]
    got = {x["doc_id"]: x["by"] for x in residue.residue_documents(spark.createDataFrame(docs + content, "doc_id bigint, text string")).collect()}
    assert set(got) == {i for i, _ in docs} | {2000, 2001}
    assert all(got[200 + k] == "page" for k in range(len(unknown)))


def test_words_of_filler_are_learned(spark):
    r = random.Random(9)
    more = ["nullam", "ligula", "tempus", "orci", "varius"]
    docs = [(i, " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", *more]) for _ in range(20))) for i in range(60)] + [(100, "Ligula nullam orci tempus ligula varius."), (101, "Der Chor singt ligula und orci im Saal, dann geht das Licht aus."), (102, None)]
    assert {x["doc_id"] for x in residue.residue_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == {*range(60), 100}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"wort{i}" for i in range(40)]
    base = [" ".join(r.choice(words) for _ in range(30)) for _ in range(15)]
    lines = base + [b + " ende" for b in base[:8]] + ["neu " + b for b in base[:4]]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    got = rows(residue.near_duplicates(residue.fingerprints(df)))

    def sh(x):
        w = residue._rules()["MASK"].sub("0", x).split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    true = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(sh(lines[i]) & sh(lines[j])) / len(sh(lines[i]) | sh(lines[j])) >= 0.8}
    assert got <= true


@pytest.mark.parametrize("many", [2, 100])
def test_near_duplicates_link_all_pairs_of_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(residue, "MANY", many)
    r = random.Random(7)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    lines = []
    for _ in range(70):
        base = [r.choice(words) for _ in range(r.choice([8, 9, 12, 40, 70, 120]))]
        lines.append(" ".join(base))
        for _ in range(5):
            new = list(base)
            for _ in range(len(new) // 40):
                new[r.randrange(len(new))] = r.choice(words)
            lines.append(" ".join(new[r.randrange(2) :]))
    lines = sorted(set(lines)) + ["eins zwei 1", "eins zwei 22"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    got = rows(residue.near_duplicates(residue.fingerprints(df)))
    sets = [(lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(residue._rules()["MASK"].sub("0", x).split()) for x in lines]
    true = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}

    def components(pairs):
        of = list(range(len(lines)))
        for a, b in sorted(pairs):
            x, y = of[a], of[b]
            of = [min(x, y) if z in (x, y) else z for z in of]
        return of

    of = components(got)
    met = sum(of[i] == of[j] for i, j in true)
    assert got <= true and len(true) > 100 and met >= 0.97 * len(true)
    assert many < 100 or len(got) >= 0.95 * len(true)


def test_empty_tables_give_no_rows(spark):
    a = articles(spark, {"id": 1}).limit(0)
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert names.variant_pairs(a, "author").count() == 0 and main_content.main_content(a).count() == 0 and truncation.truncated_fields(a).count() == 0
    assert survivors.survivors(a, feeds(spark, ("x", 1))).count() == 0 and tokenizing.token_ids(docs).count() == 0 and residue.residue_documents(docs).count() == 0
    assert repeated_lines.repeated_lines(a.select("id", "source", F.col("full_text").alias("text"))).count() == 0
    t = spark.createDataFrame([("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(docs, t)[0].count() == 0


def test_very_long_texts(spark):
    long = "Das Haus zeigt den Stoff, ohne Pause. " * 40_000
    a = articles(spark, {"id": 1, "source": "A", "full_text": long})
    assert main_content.main_content(a).count() == 1 and truncation.truncated_fields(a).count() == 1
    d = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    assert residue.residue_documents(d).count() == 0 and len(tokenizing.token_ids(d).first()["ids"]) == len(tokenizing.encode(long, tokenizing.VOCABULARY))


# --- residue: what is written, and chains of near-duplicates


def test_only_lines_near_labels_are_gathered_however_long_the_chain(spark, monkeypatch):
    r = random.Random(11)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    chain = [["404", "Not", "Found"] + [r.choice(words) for _ in range(60)]]
    for k in range(12):
        chain.append(chain[-1][:-2] + [r.choice(words), r.choice(words)] if k % 2 else [*chain[-1][4:], *(r.choice(words) for _ in range(3))])
    chain = [" ".join(x) for x in chain]
    content = [" ".join(r.choice(words) for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(chain + content)), "doc_id bigint, text string")
    gathered, near = [], residue.near_duplicates
    monkeypatch.setattr(residue, "near_duplicates", lambda prints: gathered.append(prints.count()) or near(prints))
    got = {x["doc_id"]: x["by"] for x in residue.residue_documents(docs).collect()}
    assert got == {0: "sign"} | dict.fromkeys(range(1, len(chain)), "near")
    assert len(gathered) > 1 and max(gathered) <= len(chain)


def test_repeated_lines_count_once_for_words_of_filler(spark):
    filler = [f"lorem ipsum dolor sit nullam wort{chr(97 + k)}" for k in range(10)]
    once = [(i, x) for i, x in enumerate(filler)] + [(10, "Nullam nullam nullam nullam lorem ipsum.")]
    again = [(20 + i, "Ein Satz mit nullam steht hier.") for i in range(8)]
    of = lambda docs: {x["doc_id"] for x in residue.residue_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert of(once + again) == {*range(11)}
    assert of(once + [(i, f"{x} {chr(97 + i % 26)}") for i, x in again]) == set()


def test_only_repeated_lines_are_gathered_to_count_each_line_once(spark, monkeypatch):
    once = [(f"Zeile {i} steht hier allein.", i % 2 == 0) for i in range(200)]
    again = [(f"Zeile {i % 5} steht oft", i == 7) for i in range(40)]
    gathered, write = [], truncation.written
    monkeypatch.setattr(truncation, "written", lambda df: gathered.append(df.count()) or write(df))
    got = truncation.distinct_lines(spark.createDataFrame(once + again, "line string, final boolean"))
    assert sorted(map(tuple, got.collect())) == sorted(once + [(f"Zeile {k} steht oft", k == 2) for k in range(5)])
    assert gathered == [5]


def test_texts_that_hold_no_word_of_filler_in_a_whole_partition(spark):
    filler = [(i, f"lorem ipsum dolor sit nullam wort{chr(97 + i)}") for i in range(10)]
    content = [(100 + i, f"Das Haus zeigt den Stoff {chr(97 + i % 26)}{chr(97 + i // 26)} ohne Pause.") for i in range(40)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(filler + content, 5), "doc_id bigint, text string")
    assert {x["doc_id"] for x in residue.residue_documents(docs).collect()} == set(range(10))


# --- truncation and standing lines: what is read and counted


def test_a_dollar_sign_is_no_end_of_a_line(spark):
    whole = [{"id": i, "source": "A", "title": f"Titel {i}", "full_text": f"Wort{i} beginnt den Abend. Das Haus kostet fünf $ im Jahr."} for i in range(40)]
    cut = {"id": 100, "source": "A", "title": "T", "full_text": "Das Licht geht an. Das Haus kostet fünf"}
    assert {(r["id"], r["field"]) for r in truncation.truncated_fields(articles(spark, *whole, cut)).where("truncated").collect()} == {(100, "full_text")}


def test_standing_lines_are_read_from_texts_that_hold_them_only(spark, monkeypatch):
    docs = [(None if i == 3 else i, "A", f"oft\nnur {i}" if i < 20 else f"allein {i}") for i in range(60)] + [(100 + i, "B", "auch  hier\noft") for i in range(9)]
    read, marked = [], repeated_lines._marked
    monkeypatch.setattr(repeated_lines, "_marked", lambda d, keys: read.append(d.count()) or marked(d, keys))
    df = spark.createDataFrame(docs, "id bigint, source string, text string")
    for k in (1, 2):
        assert rows(repeated_lines.repeated_lines(df, k)) == brute_lines(docs) == {("A", "oft"), ("B", "oft"), ("B", "auch hier")}
    assert max(read) <= 10


def test_lines_of_a_text_equal_each_line_cleaned(spark):
    texts = ["eins\nzwei", " a \nb", "a\n b", "a  b\nc", "a\tb", "a\u00a0b\n\u3000c\u2003", "\ufeffa\r\n\n b", "", " ", "\n", None, "a \n\n\n b ", "a\u2028b", "a\u0085b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", repeated_lines.line_array(F.col("text")).alias("x"), F.transform(F.split("text", "\n"), repeated_lines.clean_line).alias("y")).collect()
    strip = lambda x: x and "\n".join(x).strip(" ").split("\n")
    assert all(strip(r["x"]) == strip(r["y"]) for r in got)


@pytest.mark.parametrize("line", ["Titel: Wort", "pfad › hier › dort", "a: b – c", "ohne", "a:b", "", "x > y: z", "– a", "a —"])
def test_heads_are_found_where_the_pattern_finds_them(spark, line):
    c = F.lit(line)
    assert spark.range(1).select(main_content._head(c).eqNullSafe(F.regexp_extract(c, rf"^({main_content._HEAD})", 1)).alias("same")).first()["same"]
