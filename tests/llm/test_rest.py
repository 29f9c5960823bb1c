"""Near-duplicates, formatting copies, repeated lines, tokens, leakage and residue on small cases."""

import random

import numpy as np
import pytest

from strataclaim.llm import formatting, leakage, lines, nearduplicates, residue, tokens
from strataclaim.llm.textmap import WordHashes, shingle_hashes, words


def shingles(text, n=3):
    w = words(text)
    return set(zip(*(w[k:] for k in range(n))))


def corpus(rnd, n=60):
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(40)) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        w = t.split()
        w[rnd.randrange(40)] = "changed"
        out.append(" ".join(w))
    return out + [base[0], base[0].upper(), "", " ", "one two", "one two"]


@pytest.mark.parametrize("block", [1000, 2])
def test_near_duplicates_equal_brute_force(spark, block):
    texts = corpus(random.Random(1))
    df = spark.createDataFrame([(k, None if k % 2 else "", t, "clash") for k, t in enumerate(texts)] + [(9999, None, None, None)], "id long, title string, text string, band string")
    pairs, members = nearduplicates.near_duplicates(df, "id", ("title", "text"), 3, 0.5, "jaccard", block=block)
    got = {tuple(r) for r in nearduplicates.all_pairs(pairs, members).collect()}
    sets = [shingles(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got == want


def test_family_of_a_third_of_all_rows(spark):
    """Copies with edits of a passage so common that its own shingles weigh next to nothing."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    base = [word() for _ in range(80)]
    texts = [[word() for _ in range(80)] for _ in range(300)]
    for k in range(150):
        w = list(base)
        for at in rnd.sample(range(80), 1 + k % 2):
            w[at] = f"own{k}"
        texts.append(w)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    pairs, members = nearduplicates.near_duplicates(df, "id", ("text",), 3, 0.5, "jaccard")
    got = {tuple(r) for r in nearduplicates.all_pairs(pairs, members).collect()}
    sets = [shingles(" ".join(t)) for t in texts]
    assert got == {(a, b) for a in range(450) for b in range(a + 1, 450) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])} and len(got) >= 150 * 149 // 2


def test_runs_across_batches():
    """Runs of one band that go on in the next batch are paired as wholes."""
    import pyarrow as pa

    rnd = random.Random(6)
    rows = [(band, 100 * band + k) for band in range(8000) for k in range(rnd.choice([1, 1, 2, 3, 4]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[low : low + 5000])], names=["band", "key"]) for low in range(0, len(rows), 5000)]
    got = {(a, b) for out in nearduplicates._pair_runs(1000)(iter(batches)) for a, b in zip(out.column(1).to_pylist(), out.column(2).to_pylist())}
    keys = {}
    for band, key in rows:
        keys.setdefault(band, []).append(key)
    assert got == {(a, b) for ks in keys.values() for n, a in enumerate(ks) for b in ks[n + 1 :]}


def test_sampling_estimates_similarity():
    rnd = random.Random(2)
    texts = corpus(rnd)[:31] + corpus(rnd)[60:61]
    docs = [words(corpus(random.Random(1))[0]), words(corpus(random.Random(1))[60])]
    h, c = shingle_hashes(docs, 3, WordHashes())
    h = h >> np.uint64(24)
    levels = np.full(2**20, 7, np.uint8)
    hs = nearduplicates.band_hashes(h, c, levels, nearduplicates.sampling_table(), 20, 600, 1)
    a, b = (set(x.tolist()) for x in np.split(h, np.cumsum(c)[:-1]))
    assert abs((hs[0] == hs[1]).mean() - len(a & b) / len(a | b)) < 0.08 and texts


def test_formatting_copies(spark):
    rows = [(1, "Sparse embedding increases yield."), (2, "sparse\nEMBEDDING  increases – yield"), (3, "Sparse embedding increases yields."), (4, "Subject: a\nPredicate: b\nObject: c"), (5, '{"object": "C", "subject": "A", "predicate": "b"}'), (6, "object=c | predicate=b | subject=a"), (7, "object=c | predicate=b | subject=x"), (8, ""), (9, None), (10, "—"), (2, "sparse embedding increases yield")]
    df = spark.createDataFrame(rows, "id long, t string").selectExpr("*", "'x' as k", "1 as keep_id")
    for share in (1000, 1):
        records, members = formatting.copies(df, "id", formatting.fields_key("t"), hot_share=share)
        assert sorted(map(tuple, records.collect())) == [(1, 3), (3, 1), (4, 3), (7, 1), (8, 3)]
        assert sorted(map(tuple, members.collect())) == [(1, 2), (1, 2), (4, 5), (4, 6), (8, 9), (8, 10)]


def test_hot_copies_are_salted(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'Hot!' else concat('t', id) end as t")
    records, members = formatting.copies(df, "id", formatting.fields_key("t"), hot_share=10)
    assert records.where("n_copies > 1").collect() == [(0, 1000)] and members.count() == 999


def test_symmetric_relations(spark):
    df = spark.createDataFrame([(1, "a b", "ANALOGOUS TO", "c", None), (2, "C", "analogous_to", "A-B", ""), (3, "c", "causes", "ab", None), (4, "ab", "causes", "c", None)], "id long, s string, r string, t string, c string")
    _, members = formatting.copies(df, "id", formatting.pair_key("s", "r", "t", "c"))
    assert members.collect() == [(1, 2)]


def test_repeated_lines(spark):
    rows = [(k, "s", f"own text {'abcdefghij'[k]}\nSeen {k} times.\r\n12 34\nSeen {k + 1} times") for k in range(10)] + [(k, "big", f"only {k}\nrare line" if k < 104 else f"text {'x' * (k - 99)}") for k in range(100, 220)]
    rows += [(900, None, "Seen 1 times"), (901, "s", None), (902, "s", ""), (903, "s", "SEEN TIMES")]
    df = spark.createDataFrame(rows, "id long, src string, text string").selectExpr("*", "'x' as leaf", "'y' as source")
    got = sorted(map(tuple, lines.repeated_lines(df, "id", "src", "text").collect()))
    assert got == sorted([(k, n) for k in range(10) for n in (2, 4)] + [(903, 1)])
    cleaned = {r.id: (r.text, r.n_removed) for r in lines.remove_lines(df.drop("source"), "id", "src", "text").collect()}
    assert cleaned[0] == ("own text a\n12 34", 2) and cleaned[903] == ("", 1) and cleaned[901] == (None, 0) and cleaned[100] == ("only 100\nrare line", 0)


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["", None, " ", "\n\n  \t", "Hello world's <|endoftext|> 123", "数据显示 naïve café 👩‍🔬 ﬁne ½ Ⅷ", "a" * 20_000, "x  y   z ", "\u00a0\u2009\u3000q\u200b", "it's we'll I'D"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(4, texts[4], 5)], "doc_id long, text string, ids int")
    full = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    full.encode_special_tokens = True
    for size in (1_000_000, 1):
        got = tokens.encode_corpus(df, "doc_id", "text", batch_chars=size)
        rows = got.collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            assert r.ids == full.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in tokens.decode_corpus(got.dropDuplicates(["doc_id"]), "doc_id").collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_leakage_equals_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(5000)}"
    items = [[word() for _ in range(40)] for _ in range(12)]
    items[11] = items[0][5:30] + items[11][:10]
    docs = []
    for k in range(60):
        it, n = rnd.choice(items), rnd.choice([0, 10, 13, 14, 15, 25])
        at = rnd.randrange(40 - n)
        part = it[at : at + n]
        if k % 5 == 0 and n > 14:
            part = part[:7] + ["zzz"] + part[8:]
        docs.append([word() for _ in range(rnd.randrange(30))] + part + [word() for _ in range(rnd.randrange(30))])
    join = lambda ws, k: (", " if k % 3 else " ").join(w.upper() if k % 2 else w for w in ws)
    d = spark.createDataFrame([(k, join(w, k)) for k, w in enumerate(docs)] + [(500, None), (501, ""), (0, join(docs[0], 0))], "id long, text string").selectExpr("*", "1 as hash", "'x' as item_text")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")], "item long, text string")
    runs = lambda ws: {tuple(ws[k : k + 14]) for k in range(len(ws) - 13)}
    want = {(a, b) for a, x in enumerate(docs) for b, y in enumerate(items) if runs(x) & runs(y)}
    found = leakage.leaked_items(d, "id", "text", i, "item", "text")
    assert {(r.id, r.item) for r in found.where("run >= 14").collect()} == want and want
    with pytest.raises(ValueError):
        leakage.leaked_items(d, "id", "text", i, "item", "text", min_run=10)


def test_overlaps_tolerate_substitutions():
    x = [f"a{k}" for k in range(30)]
    y = x[:10] + ["b"] + x[11:]
    assert leakage.overlaps(y, x, [(0, 0)], 2) == (19, 30, 29) and leakage.overlaps(y, x, [(0, 0)], 0) == (19, 19, 19)


@pytest.mark.parametrize("text, kind", [
    ("Dear reader, this summary of {{title}} was built.", "placeholder"), ("The rate of ${journal} rose.", "placeholder"), ("Authors: [NAME]", "placeholder"), ("In {unit}, it rose.", "placeholder"), ("At %RANGE% it rose", "placeholder"), ("~RATE~FIELD~ rose", "placeholder"), ("The __kernel__ rose.", "placeholder"), ("[rate goes here] rose", "placeholder"), ("$effect_size$ rose", "placeholder"), ("<% result %>", "placeholder"), ("@VALUE@ rose", "placeholder"),
    ("Sample text goes here.", "filler"), ("Lorem ipsum dolor sit amet.", "filler"), ("asdf qwer jkl asdf", "filler"), ("xxxx xxxxx xx xxxxxxx", "filler"), ("undefined undefined undefined", "filler"), ("Abstract to be added.", "filler"), ("Velit quam tellus amet arcu nunc sed justo porta.", "filler"),
    ("404 Not Found\nThe record 5 could not be located.", "error"), ("Access denied.", "error"), ("Seite nicht gefunden.", "error"), ("Traceback (most recent call last):\nKeyError: 'x'", "error"), ("Loading...", "error"), ("Your session has expired.", "error"), ("503 Service Temporarily Unavailable.", "error"),
    ("JavaScript is required to display this article.", "script"), ("Please enable scripts to read it.", "script"), ("Bitte aktivieren Sie JavaScript.", "script"), ("Veuillez activer JavaScript et les cookies.", "script"), ("Real content here. Scripts and cookies must be allowed. More content.", "script"),
])
def test_residue(text, kind):
    assert residue.evidence(text)[0][0] == kind


@pytest.mark.parametrize("text", [None, "", " \n", "Pages that ask readers to enable JavaScript made up 8 percent of the crawl.", "Authors often leave {{title}} style markers in drafts, and we count them by hand.", "The placeholder effect, in which [NAME] tags are read aloud, was strongest here.", "Filler such as lorem ipsum was used by the raters as a control stimulus.", "The server returned an internal error in 32 of the runs, which we report as missing.", "Access was denied to 708 applicants, whose later income we follow.", "We crawled 9 landing pages and logged how often a 404 reply replaced the paper.", "In the code, `\"{0}\".format(x)` and `printf(\"%s\")` print the state.", "Let $x_{i}$ and \\frac{a}{b} denote the load; see [20] and <1, 9>.", "The set {x : x > 3} was excluded.", "Prices are $11 or $574, and 5% of them were capped.", "Typing tests used the strings asdf and jkl to warm up the fingers."])
def test_no_residue(text):
    assert residue.evidence(text) == []


def test_residue_of_hosts(spark):
    footer = "This site needs JavaScript."
    rows = [(k, "h", f"Good text {k}.\n{footer}") for k in range(30)] + [(50, "other", footer), (51, None, "Access denied."), (52, "h", None), (53, "h", ""), (54, "h", "good " * 50_000 + "404 Not Found")]
    df = spark.createDataFrame(rows, "id long, host string, text string").selectExpr("*", "'x' as kind")
    assert sorted(r.id for r in residue.residue(df, "id", "host", "text").select("id").distinct().collect()) == [50, 51, 54]


def test_residue_that_repeats(spark):
    """Error pages, fillers and bare script notices stay evidence however many documents of a host are one."""
    often = ["404 Not Found", "Lorem ipsum dolor sit amet.", "Please enable JavaScript to view this page."]
    rows = [(k, "h", f"Good text {'x' * k}.") for k in range(300)]
    rows += [(1000 + 100 * n + k, f"h{n}", line) for n, line in enumerate(often) for k in range(60)]
    rows += [(2000 + k, "mixed", f"Good text {'y' * k}.\n404 Not Found\nAll rights are reserved.") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    found = {r.id for r in residue.residue(df, "id", "host", "text").select("id").distinct().collect()}
    assert found == {i for i, _, t in rows if i >= 1000}


#: One text or more for every alternative of the evidence patterns.
EVIDENCE = """{{title}}|{% if x %}|<% result %>|<?php x?>|${journal}|#{name}|@{name}|{0}|{unit}|{ÜBER}|<< name >>|[[ name ]]|%RANGE%|%ÄÖÜ%|%(name)s|%(ärzte)s|@VALUE@|@ÄÖÜ@|@__AB@|~RATE~|~ÄÖÜ~|##NAME##|__kernel__|__état__|$effect_size$|$état_x$|[insert x]|[TBD]|[12 goes here]|[12 go here]|[12 text here]|[12 to be inserted]|[NAME]|[AB CD]|<insert x>|<title>|<ÄÖÜ>
JavaScript is required.|JS is required to view this page.|JS must be enabled to go on.|Cookies are blocked.|Scripting is turned off.|Please enable scripts.|This page requires Java script.|Bitte erlauben Sie Skripte.|Skripte bitte aktivieren.|Включите JavaScript|请启用脚本|Your browser does not support it: turned off|noscript
404 Not Found|400 Bad Request|408 Request Timeout|418 - error|451: x|402 page|403 forbidden|410 gone|505 error|HTTP 411 error|error 599: x|erreur 404|Fehler 404|HTTP status 200|It could not be retrieved.|The page was not found.|The file cannot be opened.|The site has moved or so.|The paper was removed from here.|The paper has been removed.|The page does not exist.|The item is temporarily withdrawn.|Seite wurde nicht gefunden|nicht mehr verfügbar|página no encontrada|page introuvable|page non trouvée|pagina non trovata|страница не найдена|页面不存在|vous n'êtes pas autorisé|vuelva a intentarlo
Access denied|You do not have access to this document.|does not have permission|not authorized to view|too many requests|service unavailable|bad gateway|gateway timeout|internal server error|connection to x timed out|connection was reset|connection refused|something went wrong|failed to load|unable to load the x|Oops|oops!|Loading...|please try again later|reload the page|your session has expired|your session timed out|log in again|prove that you are human|verify you are human|verify that you are human|checking your browser|complete the captcha: captcha below
Traceback (most recent call last)|KeyError: x|java.lang.Exception: x|at a.b.C.run(C.java:112)|fatal error: x|stack trace:|NullPointerException|segmentation fault
lorem ipsum|dummy text.|sample copy,|example content here|filler text.|abstract goes here|placeholder copy for|Blindtext|Fülltext|Platzhaltertext|hier steht bald|texte de remplissage|texto de relleno|testo segnaposto|текст-заполнитель|占位|Keywords to be added|Figure 1 coming soon|Details to follow|replace this with|to be filled in|to be written later|coming soon!|abstract: none|null none nan|nan null none|none null null|undefined nan null|test, test, test|test,test,test|test  test  test|test 12 test please ignore|please ignore this entry|asdf qwer zxcv|jkl jkl jkl|xx xxx xx xxxx|bla bla bla|bla,bla,bla|Foo foo FOO foo foo|foo bar baz|abc abc abc
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.|Duis aute irure in reprehenderit voluptate esse cillum.|The page was not«x»found.|Pleaſe enable ſcripts."""


@pytest.mark.parametrize("text", [t for line in EVIDENCE.split("\n") for t in line.split("|")])
def test_evidence_passes_the_sift(text):
    assert residue.evidence(text) and residue.is_suspect(text)


def test_words_of_bytes_are_words():
    import pyarrow as pa

    from strataclaim.llm.textmap import joined_text, run_hashes, word_hashes

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aB9 ,.-–é\n\tЖ数") for _ in range(rnd.randrange(60))) for _ in range(200)] + [None, "", " "]
    titles = [rnd.choice([None, "Ab cd", "é"]) for _ in texts]
    flat, sizes = word_hashes(joined_text([pa.array(titles), pa.array(texts)]))
    docs = [words(" ".join(x for x in row if x)) for row in zip(titles, texts)]
    assert sizes.tolist() == [len(d) for d in docs]
    known = {}
    for w, h in zip([w for d in docs for w in d], flat.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    h, counts = run_hashes(flat, sizes, 3)
    assert counts.tolist() == [max(0, len(d) - 2) for d in docs] and len(h) == counts.sum()
    spelt = [tuple(d[k : k + 3]) for d in docs for k in range(len(d) - 2)]
    assert len({(s, x) for s, x in zip(spelt, h.tolist())}) == len(set(spelt)) == len(set(h.tolist()))


def test_repeated_shingles_weigh_their_frequency(spark):
    """Weighted similarity counts a shingle as often as both records have it; the set's counts it once."""
    a, b = "one two three four " * 6 + "a b c d e f", "one two three four " * 3 + "a b c d e f"
    df = spark.createDataFrame([(1, a), (2, b), (3, "other words " * 9)], "id long, text string")
    pairs, _ = nearduplicates.near_duplicates(df, "id", ("text",), 3, 0.1, "jaccard")
    (r,) = pairs.where("rep_a = 1 and rep_b = 2").collect()
    from collections import Counter

    grams = [Counter(zip(w, w[1:], w[2:])) for w in (words(a), words(b))]
    assert r.jaccard == pytest.approx(len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
    # with three records every shingle is common, so all weigh the same
    assert r.weighted_jaccard == pytest.approx(sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values()))


def test_copies_are_sent_once_and_long_runs_leave_in_blocks(spark):
    import pyarrow as pa

    rows = [(1, k) for k in range(2500)] + [(2, 7), (2, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[low : low + 300])], names=["band", "key"]) for low in range(0, len(rows), 300)]
    out = [b for b in nearduplicates._pair_runs(1000)(iter(batches))]
    assert max(b.num_rows for b in out) <= 1301
    blocks = [(b.column(2)[k].as_py(), b.column(3)[k].as_py()) for b in out for k in range(b.num_rows) if b.column(0)[k].as_py() == 1]
    assert sorted(k for k, _ in blocks) == list(range(2500)) and {at for _, at in blocks} == {0, 1, 2}
    copies = spark.createDataFrame([(k, "the very same words again " * 9) for k in range(3000)] + [(9000, "the very same words again " * 9 + "more")], "id long, text string")
    pairs, members = nearduplicates.near_duplicates(copies, "id", ("text",), 3, 0.5, "jaccard")
    assert [tuple(r)[:2] for r in pairs.collect()] == [(0, 9000)] and members.where("rep = 0").count() == 3000


def test_token_trees():
    tree = lines.TokenTree(2)
    for line in ("Seen 3 times, shared 5", "Seen 44 times, shared 5 !", "seen - times shared", "Other line 7"):
        tree.add("s", lines.letters(line), line)
    rows = {path: (slots, n) for _, path, _, _, slots, n in tree.rows()}
    assert rows == {"5 seen <*>": (2, 2), "4 seen <*>": (1, 1), "3 other line": (1, 1)} and tree.size == 3
    assert lines.tokens("Éa 12 -- x9,b") == ["éa".encode(), lines.SLOT, b"xb"] and lines.letters("Éa 12 x9") == "éax".encode()


@pytest.mark.parametrize("most", [1, 10**6])
def test_trees_are_merged(spark, most):
    """Templates of one line are added over partitions, sent-off trees and spellings; a document counts once."""
    texts = ["Share this", "share  THIS!", "Sharethis\nShare this", "Share 5 this"] * 5
    df = spark.createDataFrame([("s", f"{t}\nown {'x' * k}") for k, t in enumerate(texts)] + [(None, "Share this")], "src string, text string").repartition(7)
    (r,) = lines.repeated_templates(df, "src", "text", max_templates=most).collect()
    assert (r.n_docs, r.n_source, r.templates, r.slots) == (20, 20, 3, 1)


@pytest.mark.parametrize("held", [0, 10**6])
def test_lines_beyond_what_tasks_hold(spark, held):
    rows = [(k, "s", f"own {'x' * k}\nFollow us\n\nFollow US ") for k in range(30)] + [(99, None, "Follow us")]
    df = spark.createDataFrame(rows, "id long, src string, text string")
    assert sorted(map(tuple, lines.repeated_lines(df, "id", "src", "text", max_held=held).collect())) == [(k, n) for k in range(30) for n in (2, 4)]
    got = {r.id: (r.text, r.n_removed) for r in lines.remove_lines(df, "id", "src", "text", max_held=held).collect()}
    assert got == {k: (f"own {'x' * k}\n", 2) for k in range(30)} | {99: ("Follow us", 0)}
    pages = spark.createDataFrame([(k % 7, "h", f"Good {'y' * k}\nAll rights reserved") for k in range(60)] + [(3, "h", "404 Not Found\nAll rights reserved")], "id long, host string, text string")
    assert [tuple(r)[:2] for r in residue.residue(pages, "id", "host", "text", max_held=held).collect()] == [(3, "error")]


def test_bitmap_holds_every_hash_and_little_else(spark):
    rnd = np.random.default_rng(9)
    hashes = rnd.integers(0, 2**63, 5000, np.int64)
    seeds = spark.createDataFrame([(int(h),) for h in hashes], "hash long")
    for bits in (16, 20, 22):
        bitmap = np.frombuffer(leakage.bitmap_of(seeds, bits), np.uint8)
        assert len(bitmap) == 2**bits // 8
        assert len(leakage._in_bitmap(hashes.view(np.uint64), bitmap, bits)) == 5000
    assert len(leakage._in_bitmap(rnd.integers(0, 2**63, 100_000, np.int64).view(np.uint64), bitmap, bits)) < 20
