"""The corpus operators against brute force, and their corner cases."""

import gzip
import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quintavote.llm import (
    byte_bpe,
    chat_repair,
    decontaminate,
    html_wrapper,
    language_id,
    line_templates,
    parity_join,
    quality_ledger,
    registered,
    suffix_dedup,
    warc,
)

DOCS = "doc_id long, text string, lang string, leaf string, own string, key long"
SMALL = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, None, "x", "y", 7) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


def texts_of(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


# 1 -- substrings


def cut_by_force(rows, size=50):
    first = {}
    for i, text in sorted((i, t or "") for i, t in rows if i is not None):
        data = text.encode()
        for p in range(len(data) - size + 1):
            first.setdefault(data[p : p + size], i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if i is not None and first[data[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(data), len(data) - len(kept), spans, kept))
    return Counter(out)


def cut(frame, **settings):
    rows = suffix_dedup.dedup_substrings(frame, **settings).collect()
    return Counter(
        (r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows
    )


def test_substrings_equal_brute_force(spark, small):
    want = cut_by_force(texts_of(small))
    assert cut(small) == want
    # Tiny shards, ranges and chunks: everything meets across their borders.
    assert cut(small.repartition(5), shard_bytes=20_000, range_bytes=50_000, chunk_bytes=3_000) == want


def test_substrings_corner_cases(spark):
    shared = "the quick brown fox jumps over the lazy dog near the river bank é" * 2
    rows = [
        (5, shared), (5, shared), (3, "x" + shared + "y"), (9, "ab" * 400), (8, "ab" * 30),
        (1, None), (2, ""), (4, "short"), (None, shared), (7, shared[:70] + "…" + shared[20:]),
        (6, "z" * 300_000 + shared),
    ]
    assert cut(documents(spark, rows)) == cut_by_force(rows)
    assert cut(documents(spark, rows), shard_bytes=100, range_bytes=200, chunk_bytes=100) == cut_by_force(rows)
    assert not cut(documents(spark, []))


# 2 -- quality


def test_ledger_corner_cases(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a b c a b c"), (4, words), (4, words), (None, "x\n\nx\ny")]
    found = quality_ledger.ledger(documents(spark, rows)).collect()
    by = {(r.doc_id, r.n_words): r for r in found}
    assert len(found) == 6 and by[1, 0].fail_bits & 1 and by[2, 0].word_chars == 0
    assert by[3, 6].n_repeat_words == 6 and by[3, 6].fail_bits & 2
    assert by[4, 60].fail_bits == 0
    assert (by[None, 3].n_dup_lines, by[None, 3].n_lines) == (1, 3)
    assert quality_ledger.ledger(documents(spark, [])).count() == 0


def test_ablations_count_bits(spark, small):
    rows = quality_ledger.ledger(small).cache()
    bits = [r.fail_bits & quality_ledger.STANDARD.mask for r in rows.collect()]
    for r in quality_ledger.ablations(rows, quality_ledger.STANDARD).collect():
        bit = quality_ledger.BITS[r.rule]
        assert r.n_failed == sum(b & bit > 0 for b in bits)
        assert r.n_only == sum(b == bit for b in bits)


def test_standard_policy_follows_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality_ledger.apply_policy(quality_ledger.ledger(docs), quality_ledger.STANDARD)
    rows = kept.join(labels, "doc_id").where("n_words >= 50").select("quality", "kept").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97


# 3 -- lines


def test_recurring_templates_keep_their_first_document(spark):
    rows = [(i, f"own text of {chr(97 + i)} alone\nPosted on 2024-01-{i:02d} by anna in news\n\nend") for i in range(6)]
    rows += [(None, "Posted on 2025-05-05 by anna in news"), (20, None), (21, ""), (22, "rare line here now")]
    got = {r.doc_id: r for r in line_templates.drop_recurring(documents(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == rows[0][1]
    assert got[3].text == "own text of d alone\n" and got[3].n_dropped == 2 and got[3].n_lines == 4
    assert got[None].text == "" and got[20].text is None and got[20].n_lines == 0
    assert got[21].text == "" and got[21].n_lines == 1 and got[22].n_dropped == 0
    assert got[3].leaf == "x" and got[3].own == "y" and got[3].key == 7
    assert line_templates.drop_recurring(documents(spark, [])).count() == 0


def test_places_with_many_values_are_fields(spark):
    names = ["ann", "bob", "cy", "dee", "eve", "flo", "gus", "hal", "ida", "jon", "kim"]
    line = "this page was kindly written for you by {} today"
    rows = [(i, line.format(n)) for i, n in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(documents(spark, rows)).collect()}
    assert got == {i: int(i > 0) for i in range(len(names))}
    # Prose that only begins alike is left alone.
    prose = [(i, f"it was a {n} and {n}y {n}ing {n}ed of {n}s") for i, n in enumerate(names)]
    assert all(r.n_dropped == 0 for r in line_templates.drop_recurring(documents(spark, prose)).collect())


def test_long_lines_recur_from_two_documents_on(spark):
    line = "this one passage of some words stands in {} and in another document too"
    rows = [(1, "own a\n" + line.format("1")), (2, line.format("2") + "\nshort line\nown b"), (3, "short line\nown c")]
    rows += [(4, "one more passage of many words that only its own document has")]
    found = line_templates.drop_recurring(documents(spark, rows), line_docs=2).collect()
    assert {r.doc_id: r.text for r in found} == {**dict(rows), 2: "short line\nown b"}


# 4 -- languages


def test_language_accuracy_and_corner_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = registered.op4_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(
        docs.select("doc_id", "lang"), "doc_id"
    ).collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    known = language_id.learn(docs)
    odd = documents(spark, [(1, None), (2, ""), (3, "12 ... 7"), (4, "the one " * 200_000), (None, "the")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, known).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and None in got
    assert language_id.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_long_text_is_bundled_like_its_parts():
    vectors = language_id._Vectors(256)
    text = "alpha beta gamma " * 40_000
    whole = language_id.bundles([text], vectors)[0]
    parts = language_id.bundles(["alpha beta gamma " * 100], vectors)[0]
    cosine = whole @ parts / np.linalg.norm(whole) / np.linalg.norm(parts)
    assert cosine > 0.99


# 5 -- pages

PAGES = "page_id long, url string, html string, wrapper string, host string"


def page_rows(spark, rows):
    return spark.createDataFrame([(*r, "w", "h") for r in rows], PAGES)


def test_article_text_of_the_test_pages(spark):
    import html as entities

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in html_wrapper.extract_text(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        clean = [" ".join(entities.unescape(b).split()) for b in blocks]
        assert got[page.page_id] == "\n".join(b for b in clean if b)


def test_furniture_is_left_out(spark):
    shell = (
        "<!doctype html><title>t</title><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div>{}<aside>Side</aside>"
        "<form><p>Search</p></form><footer>Foot</footer><script>var a='<p>no</p>'</script>"
    )
    body = "<main><h1>A &amp; B{0}</h1><p>One\n  <b>bold</b>word &eacute;<p>Two {0}<ul><li>x<li>y</ul><div class=ad>Buy</div><section id=comments><p>Nice!</p></section></main>"
    rows = [(i, f"https://User@Host.example:8{i}/p", shell.format(body.format(i))) for i in range(3)]
    rows += [(7, None, None), (8, "bad url", ""), (9, "http://h.example", "<p>cut <b>mark"), (9, "http://h.example", "<p>cut <b>mark"), (10, "http://h2.example", "<!-- open <p>x")]
    got = defaultdict(list)
    for r in html_wrapper.extract_text(page_rows(spark, rows)).collect():
        got[r.page_id].append(r.text)
    assert got[1] == ["A & B1\nOne boldword é\nTwo 1\nx\ny"]
    assert got[7] == [""] and got[8] == [""] and got[9] == ["cut mark"] * 2 and got[10] == [""]
    assert html_wrapper.extract_text(page_rows(spark, [])).count() == 0


def test_constant_texts_are_furniture_where_there_is_no_article(spark):
    rows = [(i, "http://a.example/", f"<div><h2>Same words</h2></div><div><p>text {i}</p></div>") for i in range(9)]
    got = {r.page_id: r.text for r in html_wrapper.extract_text(page_rows(spark, rows)).collect()}
    assert got[4] == "text 4"


def test_wrappers_get_optional_and_repeated_groups():
    nodes = [html_wrapper.page_nodes(html_wrapper.tokens(p)) for p in (
        "<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul>", "<ul></ul><p>y</p>")]
    merged = html_wrapper.merge(html_wrapper.merge(nodes[0], nodes[1]), nodes[2])
    groups = [n for n in merged if n[0] == "+"]
    assert len(groups) == 1 and groups[0][2]
    assert [n[2] for n in merged if n[:2] == ["<", "p"]] == [True]


# 6 -- benchmark

ITEM = "A farmer sells 12 kg of ripe apples to Maria and 7 kg of green pears to Jonas before noon"


def test_reparameterised_items_are_found(spark):
    other = "A farmer sells 40 pounds of ripe apples to Petra and 9 pounds of green pears to Oskar before noon"
    mixed = "A farmer sells 40 pounds of ripe apples to Petra and 40 pounds of green pears to Petra before noon"
    rows = [(1, f"Intro words here. {ITEM}. More."), (2, f"So: {other}!"), (3, mixed), (4, "nothing of the kind"), (5, None), (6, ""), (None, ITEM), (1, f"{ITEM} again")]
    bench = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "5 6 7", 1), (10, ITEM, 1)], "item_id long, text string, doc long")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.find(documents(spark, rows), bench).collect()}
    assert got == {(1, 10): False, (2, 10): True}
    assert decontaminate.find(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find(documents(spark, []), bench).count() == 0


@pytest.mark.parametrize("case", [str.upper, str.lower, str.title, str.swapcase])
def test_items_are_found_in_any_case(spark, case):
    german = "Wie viele Kinder aus der kleinen Straße essen 12 große Äpfel"
    bench = spark.createDataFrame([(10, ITEM), (11, german)], "item_id long, text string")
    rows = [(1, case(f"Intro words here. {ITEM}. More.")), (2, case(german)), (3, case(ITEM.replace("12", "31")))]
    rows += [(4, case("some other words that no item of this benchmark has in it"))]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.find(documents(spark, rows), bench).collect()}
    assert got == {(1, 10): False, (2, 11): False, (3, 10): True}


def test_short_items_have_one_window(spark):
    bench = spark.createDataFrame([(1, "how are you today")], "item_id long, text string")
    got = decontaminate.find(documents(spark, [(1, "well, how are you today?"), (2, "how are you")]), bench)
    assert [(r.doc_id, r.n_windows, r.n_hit) for r in got.collect()] == [(1, 1, 1)]


# 7 -- conversations

TURNS = "conv_id long, turn long, role string, text string, chunk long"


def price_by_force(roles):
    """Least cost over all ways to assign, merge and insert."""
    best = float("inf")
    own = [chat_repair._own(r) for r in roles]
    for choice in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, cost = chat_repair.START, 0.0
            for o, c, m in zip(own, choice, merges, strict=True):
                cost += 0 if o == c else chat_repair.RELABEL
                if m:
                    if c != state:
                        break
                    cost += chat_repair.MERGE
                    continue
                # Shortest run of empty turns from state to c.
                legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
                ways = [(s,) for s in legal[state] if s == c] + [(s, c) for s in legal[state] if c in legal[s]]
                if not ways:
                    break
                cost += chat_repair.INSERT * (min(map(len, ways)) - 1)
                state = c
            else:
                best = min(best, cost + chat_repair.final_cost()[state])
    return best


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repair_costs_equal_brute_force(n):
    for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
        total = chat_repair.summary(list(roles))
        assert (total[chat_repair.START] + chat_repair.final_cost()).min() == price_by_force(roles)


def rendered(spark, rows, chunk=chat_repair.CHUNK):
    frame = spark.createDataFrame([(*r, 5) for r in rows], TURNS)
    got = defaultdict(list)
    for r in chat_repair.repair(frame, chunk).orderBy("conv_id", "chunk", "seq").collect():
        got[r.conv_id].append(r)
    return got


def test_rendering_is_legal_and_whole(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "bot", "c"), (2, 0, "assistant", None), (None, None, None, "q"), (None, 1, "USER ", "r"), (1, 2, "bot", "c"), (3, 5, "system", "s")]
    rows += [(9, i, ("user", "assistant", "user")[i % 3], f"t{i}") for i in range(300)]
    for chunk in (chat_repair.CHUNK, 7):
        got = rendered(spark, rows, chunk)
        assert sum(map(len, got.values())) == len(rows)
        for turns in got.values():
            text = "".join(t.rendered for t in turns)
            roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
            assert text.count("<|im_end|>\n") == len(roles) and roles[-1] == "assistant"
            body = roles[1:] if roles[0] == "system" else roles
            assert body == ["user", "assistant"] * (len(body) // 2)
            assert all((t.role is None or True) and text for t in turns)
        assert "".join(t.rendered for t in got[1]).startswith("<|im_start|>user\na\nb<|im_end|>")
    whole, cut_up = rendered(spark, rows), rendered(spark, rows, 7)
    cost = lambda ts: sum({"merge": 1, "relabel": 2}.get(t.action, 0) + 3 * (t.inserted + t.closed) for t in ts)
    assert cost(whole[9]) == cost(cut_up[9])
    assert not rendered(spark, [])


# 8 -- similarity


def components_by_force(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(words))
        sets.setdefault(i, []).append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, found in sets.items():
        for x in set().union(*found) if i is not None else ():
            holders[x].add(i)
    for i, j in {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}:
        if any(100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j] if a and b):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), find(i)) for i, found in sets.items() for s in found)


def similar(frame):
    return Counter(tuple(r) for r in parity_join.similar_components(frame).collect())


def test_similarity_equals_brute_force(spark, small):
    assert similar(small) == components_by_force(texts_of(small))


def test_similarity_corner_cases(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 900)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "one two"), (7, "x " * 4000), (8, "x " * 9)]
    for k in range(40):  # a chain of drifting copies around the limit, over a size band
        words = list(base)
        for p in rng.integers(0, len(words), int(rng.integers(0, 40))):
            words[p] = f"new{k}"
        rows.append((100 + k, " ".join(words[: int(rng.integers(650, 900))])))
    rows += [(100, rows[-1][1]), (999, " ".join(base * 3))]
    assert similar(documents(spark, rows)) == components_by_force(rows)
    assert not similar(documents(spark, []))


def test_groups_of_middle_distance_are_cut_into_blocks(spark, monkeypatch):
    """Edited copies of one text, most of them nearer to it than to each other."""
    monkeypatch.setattr(parity_join, "BLOCK", 7)
    monkeypatch.setattr(parity_join, "CELLS", 64)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{rng.integers(1 << 40)}"
        rows.append((i, " ".join(words[: 150 - int(rng.integers(0, 20))])))
    expected = components_by_force(rows)
    assert similar(documents(spark, rows)) == expected
    assert 1 < len({c for _, _, c in expected}) < 120


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 70), (70, 90), (5, 5)]
    got = dict(parity_join.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, 70: 70, 90: 70, 100: 70}


# 9 -- tokens


def test_round_trip_and_safe_boundaries(spark):
    import public_tokenizers as tokenizers

    ranks, pattern = tokenizers.path(registered.RANK_FILE), tokenizers.PATTERN
    encoding = byte_bpe._encoding(ranks, pattern)
    long = "It's  a long\ttext, don't   split it wrongly!  \n 12 345 é漢字 <|endoftext|> " * 3_000
    rows = [(1, None), (2, ""), (3, long), (4, "a" * 5_000), (5, " " * 3_000 + "x"), (6, "👩‍👩‍👧 é"), (None, "q")]
    coded = byte_bpe.decode(byte_bpe.encode(documents(spark, rows), ranks, pattern), ranks, pattern)
    got = {r.doc_id: r for r in coded.collect()}
    for i, text in rows:
        want = encoding.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded).decode() == (text or "") and got[i].leaf == "x"
    assert len(list(byte_bpe.pieces(long, 1_000))) > 10
    assert byte_bpe.encode_text(long, ranks, pattern, 50) == bytes(got[3].ids)
    assert byte_bpe.encode(documents(spark, []), ranks, pattern).count() == 0


# 10 -- archives


def archived(spark, rows, folder, per_file=100):
    frame = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_monolithic(warc.records(frame), f"file://{folder}/mono", per_file)
    index = warc.normalise(spark, f"file://{folder}/mono", f"file://{folder}/norm")
    return index, warc.read_back(spark, f"file://{folder}/norm")


def test_archives_round_trip(spark, tmp_path):
    big, bigger = "é" * 600 + "\r\n\r\nWARC/1.0\r\n", "y" * 200_000
    rows = [(1, "http://a/", big), (5, "http://b\n/", big), (3, None, big), (None, "u", big), (5, "again", big), (2, "u", None), (4, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", bigger)]
    index, back = archived(spark, rows, tmp_path, per_file=3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect())
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 5
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None] += 1
    assert got == want
    payloads = {r.page_id: bytes(r.payload) for r in back.where("payload IS NOT NULL").collect()}
    assert payloads[8].decode() == bigger and payloads[5].decode() == big
    # Every record is a gzip member of its own at its indexed place.
    for r in index.collect():
        with open(r.archive.removeprefix("file://"), "rb") as archive:
            archive.seek(r.offset)
            assert gzip.decompress(archive.read(r.length)).startswith(b"WARC/1.0\r\n")


def test_no_pages_no_records(spark, tmp_path):
    _, back = archived(spark, [], tmp_path)
    assert back.count() == 0


def test_cut_streams_are_refused(tmp_path):
    import io

    data = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    with pytest.raises(EOFError):
        io.BufferedReader(warc.Inflated(io.BytesIO(data[:-12]))).read()


# Measured cases of earlier rounds


def test_long_texts_have_the_ngrams_of_the_whole(monkeypatch):
    texts = ["", "a", " . ", "ab  cd", "x" * 40, "é1 2 b", "It is. A longer text, with words; and 123 numbers!", "漢字 \U0001f642 ab "]
    for text in texts:
        whole = Counter(np.concatenate([np.empty(0, np.int64), *language_id._grams(text)]).tolist())
        for chars in range(1, 9):
            parts = [np.empty(0, np.int64), *language_id._grams(text, chars)]
            assert Counter(np.concatenate(parts).tolist()) == whole, (text, chars)


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar no-ads"><article><p>The text.</p></article></body>',
        '<html id="share"><body><div class="post-share-story"><p>The text.</p></div></body></html>',
        '<body class="home comments"><div class="sidebar"><p>aside</p></div><main><p>The text.</p></main></body>',
    ],
)
def test_pages_whose_names_resemble_furniture(page):
    assert html_wrapper.extract(page, None) == "The text."
