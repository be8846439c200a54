import random

from tidelog.llm import chains, mojibake

WORDS = {
    "fr": "été château forêt crème leçon déjà où hôtel élève cœur fenêtre très façade garçon".split(),
    "pt": "canção irmão manhã lição coração confusão atenção AMANHÃ… LÃ® «IRMÃ» amanhã".split(),
    "pl": "żółty później ogród książkę śmiech źródła łóżkiem świetnie kolację".split(),
    "cs": "příběh žlutý řeky šátek svítání můj večeři mlýnem".split(),
    "ru": "песню реки лодку трамвай город письмо ключ ужина".split(),
    "el": "λίμνη θάλασσα γράμμα τραγούδι δείπνο μουσική".split(),
    "tr": "şemsiyeyi kıyısında ağaç şarkıyı güzel öyleyse yağmurlu".split(),
    "ja": ["これは何？", "古い舟を夜明け前に。", "地下室の鍵を"],
    "en": ["£40", "café", "naïve", "don’t", "♪", "…", "plain", "words", "here"],
}


def corpus(n=600, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, lang, "\n".join(" ".join(rnd.choice(WORDS[lang]) for _ in range(6)) for _ in range(4))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, _, t in rows], "doc_id long, text string, word string, n long")


def found(spark, rows):
    g = mojibake.find(frame(spark, rows))
    return {r.doc_id for r in g.documents.collect()}, g


def test_chains_invert_strictly():
    for chain in chains.CHAINS:
        for w in (w for words in WORDS.values() for w in words):
            g = chains.garble(w, chain)
            if g is not None and "�" not in g:
                assert chains.ungarble(g, chain) == w, (chain, w)
    assert chains.ungarble("日", ("utf-8", "cp1252")) is None and chains.ungarble("Ã", ("utf-8", "latin-1")) is None


def test_clean_text_is_not_found(spark):
    rows = corpus()
    rows += [(10_000, "en", "“MANHÃ” MAÇÃ™ ÂŞIK ŠĐČĆŽ ¬§ ½ © »"), (10_001, "", None), (10_002, "", ""), (10_003, "", " \n"), (10_004, "fr", "caf&eacute; &Auml;pfel")]
    assert found(spark, rows)[0] == set()


def test_every_kind_of_garbling(spark):
    rows = corpus(900)
    rnd = random.Random(5)
    true, clean, used = set(), {}, {}
    wanted = [(w, r) for w, r in chains.CHAINS if (w, r) in {("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("cp1253", "latin-1"), ("cp1250", "cp1252"), ("mac_roman", "cp1252"), ("koi8_r", "cp1251"), ("euc_jp", "latin-1")}]
    for k, (i, lang, text) in enumerate(rows):
        if k % 8 == 0:
            chain = rnd.choice(wanted)
            g = chains.garble(text, chain)
            if g is not None and g != text and (chain[0] in chains.MULTIBYTE or sum(a != b for a, b in zip(g, text)) > 8):
                rows[k] = (i, lang, g)
                true.add(i)
                clean[i], used[i] = text, chain
    single = [(20_000, "en", "only the cafÃ© here"), (20_001, "en", "costs Â£40 now"), (20_002, "en", "donâ€™t"), (20_003, "fr", "Ã©tÃ©".lower()), (20_004, "en", "a caf�"), (20_005, "en", "ï»¿1\nplain"), (20_006, "en", "ÿþ1"), (20_007, "en", "wait\x85"), (20_008, "en", "donât")]
    twice = chains.garble(chains.garble("la forêt et le château", ("utf-8", "cp1252")), ("utf-8", "cp1252"))
    single.append((20_009, "fr", twice))
    got, g = found(spark, rows + single)
    assert got == true | {i for i, _, _ in single}
    back = {r.doc_id: r for r in mojibake.restore(frame(spark, rows + single), g).collect()}
    same = [i for i in true if back[i].restored == clean[i]]
    assert len(same) >= 0.9 * len(true)
    assert back[20_000].restored == "only the café here" and back[20_000].complete
    assert back[20_009].restored == "la forêt et le château"
    assert not back[20_004].complete


def test_held_out_accuracy_of_the_predicted_chain():
    counted = [(w, 20) for words in WORDS.values() for w in words if not w.isascii()]
    model = mojibake.train(counted)
    rnd, right, total = random.Random(3), 0, 0
    for lang, items in WORDS.items():
        for _ in range(150):
            text = [f"{rnd.choice(items)}-{rnd.choice(items)}" for _ in range(6)]  # pairs that are no training words
            chain = rnd.choice([c for c in chains.CHAINS if c[1] != "cp932"])
            g = [chains.garble(w, chain) for w in text]
            if None in g or g == text or all(w.isascii() for w in g) or chain[0] not in chains.MULTIBYTE and sum(a != b for a, b in zip("".join(g), "".join(text))) < 3:
                continue
            total += 1
            said = model.of_words([w for w in g if not w.isascii()])
            best = chains.CHAINS[int(said[:-1].argmax())]
            right += all(chains.ungarble(w, best) == t for w, t in zip(g, text))  # chains that give the same text are one
    assert total > 100 and right >= 0.9 * total, (right, total)
    said = model.predict([w for w, _ in counted])  # clean words: most are called clean; the inversion decides about the rest
    assert sum(c is None for c in said) >= 0.8 * len(said)


def test_letter_sums_find_every_inverse():
    letters = chains.letters(mojibake.EDGE)
    for w in ["été", "príběh", "žlutý", "аб…", "日本", "“LÃ”", "İz"]:
        for c in chains.SINGLE:
            o = chains.ungarble(w, c)
            hits = [x for _, x in letters.inverses([w, "é"], lambda s: s == mojibake.np.uint64(letters.of(o or ""))) if x == c]
            assert o is None or hits, (w, c)


def test_nothing_but_garbled_words_is_changed():
    model = mojibake.train([("été", 5), ("forêt", 5)])
    tried = {("utf-8", "cp1252")}
    text = "<i>Tom &amp; Jerry &lt;b&gt;</i> cafe\u0301 caf&eacute;\r\nla forÃªt &amp; &Atilde;&copy;t&Atilde;&copy; ici\r\n e\u0301"
    out, chain = mojibake.restored(text, {"forÃªt": "forêt", "Ã©tÃ©": "été"}, tried, model)
    assert out == "<i>Tom &amp; Jerry &lt;b&gt;</i> cafe\u0301 caf&eacute;\r\nla forêt &amp; été ici\r\n e\u0301"
    assert chain == ("utf-8", "cp1252")
    assert mojibake.restored("ï»¿1\nplain", {}, set(), model)[0] == "\ufeff1\nplain"


def test_empty(spark):
    assert found(spark, [])[0] == set()
    assert found(spark, [(1, "", None)])[0] == set()


def test_long_texts_and_repeats(spark):
    base = corpus(300)
    long = " ".join(t for _, _, t in base)
    rows = base + [(1000, "", long), (1001, "", long + " Ã©tÃ© cafÃ©"), (1001, "", "again")]
    assert found(spark, rows)[0] == {1001}


def test_copies_of_a_garbled_text_bring_no_votes_for_it(spark):
    text = "la forÃªt et le chÃ¢teau dÃ©jÃ  ici"
    rows = corpus(300) + [(5000 + i, "fr", text + "\r" * (i % 2)) for i in range(150)] + [(6000, "fr", "une forÃªt")]
    assert found(spark, rows)[0] == {*range(5000, 5150), 6000}


def test_long_inverses_stand_by_themselves(spark):
    # no word of these occurs anywhere else, and the copies differ
    rare = chains.garble("восторг небывалый", ("utf-8", "cp1252"))
    rows = corpus(300) + [(5000 + i, "ru", f"{i} {rare}") for i in range(40)]
    rows += [(6000, "cs", "ÄŒtvrtohornÃ\xad"), (6001, "ru", "Этого слова нет, уйдите раз"), (6002, "ja", "ｶﾀｶﾅ")]
    got = found(spark, rows)[0]
    assert got == {*range(5000, 5040), 6000}


def test_sparse_garbled_words_are_found(spark):
    single = ["IimpiÃ³", "V0cÃª", "vcrkÃ¤uft", "tuviÃ©rarn0s", "lâ€™Ã©glisc", "AtcnÃ§Ã£", "LÃ¶ffcI", "Ãœbcrsetzt", "irmÃ£"]
    rows = corpus(600) + [(7000 + i, "", f"{w} here") for i, w in enumerate(single)]
    # à and lá are counted, and so are their halves ã and lã
    rows += [(8000 + i, "", f"{i} {w}") for i, w in enumerate(["à là lá Übersetzt"] * 80 + ["ã lã"] * 20)] + [(9000, "", "lÃ¡"), (9001, "", "Ã\xa0 noite")]
    clean = ["LÃ®", "IRMÃ…", "irmÃ…", "MAÇÃ™", "“IRMÃ»", "CAFÉ…", "l’égIise", "раз", "Běž", "NEMŮŽU", "KLÍČ", "ÂŞIK", "KOLACJĘ…", "там", "уйди", "«É»"]
    rows += [(10_000 + i, "", f"{w} here") for i, w in enumerate(clean)]
    assert found(spark, rows)[0] == {*range(7000, 7000 + len(single)), 9000, 9001}


def test_a_lone_legacy_word_is_found(spark):
    lone = chains.garble("večeři", ("cp1250", "cp1252"))
    assert sum(c > "\x7f" for c in lone) == 2
    assert found(spark, corpus(600) + [(7000, "cs", f"{lone} here")])[0] == {7000}


def test_every_multi_byte_chain_is_tried(spark):
    """Whatever the classifier thinks of it: a chain far below clean still finds a word the corpus has."""
    rows = corpus(600)
    for k, chain in enumerate(c for c in chains.CHAINS if c[0] in chains.MULTIBYTE):
        words = [w for ws in WORDS.values() for w in ws if (g := chains.garble(w, chain)) and g != w and sum(c > "\x7f" for c in g) > 3]
        rows += [(7000 + k, "", f"{chains.garble(words[0], chain)} here")] if words else []
    want = {i for i, _, _ in rows if i >= 7000}
    assert len(want) > 25 and found(spark, rows)[0] == want


def test_fitting_on_executors_gives_the_same(spark):
    counted = [(w, 7 + k % 5) for words in WORDS.values() for k, w in enumerate(words) if not w.isascii()]
    a, b = mojibake.train(counted), mojibake.train(counted, spark)
    assert a.chains == b.chains and mojibake.np.array_equal(a.table, b.table)


def test_accuracy_on_held_out_documents(spark):
    got = mojibake.accuracy(frame(spark, corpus(900))).collect()
    whole = [r for r in got if r.kind != "word"]
    n = sum(r.documents for r in whole)
    assert n > 50 and sum(r.found for r in whole) >= 0.9 * n
    assert sum(r.restored for r in whole) >= 0.8 * n
