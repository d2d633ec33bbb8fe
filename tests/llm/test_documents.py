import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runloom.llm import copies, leaks, mail, packing, pages, spam

BIG = "word " * 20_000


def message(body, kind="text/plain", encoding="8bit", head=""):
    return f"From: A B <a@b.example>\nSubject: s\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {encoding}\n{head}\n{body}"


def test_parts_and_encodings():
    text = "Grüße aus dem Hafen"
    b64 = base64.b64encode(text.encode()).decode()
    assert mail.readable_texts(message(b64, encoding="base64")) == [text]
    assert mail.readable_texts(message("Gr=C3=BC=C3=9Fe aus=\n dem Hafen", encoding="quoted-printable")) == [text]
    multi = f'Content-Type: multipart/mixed; boundary="xx"\n\npreamble\n--xx\nContent-Type: text/html\n\n<p>a <b>b</b>c&amp;d<br>e</p>\n--xx\nContent-Type: application/zip\nContent-Transfer-Encoding: base64\n\nAAAA\n--xx\nContent-Type: text/plain\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\n{b64}\n--xx--\nend'
    assert [" ".join(t.split()) for t in mail.readable_texts(multi.replace("\n", "\r\n"))] == ["a bc&d e", text]
    for odd in (None, "", "no header at all", "Content-Type: multipart/mixed; boundary=q\n\nno parts", message("!!!", encoding="base64"), message("=ZZ=", encoding="quoted-printable"), "\x00�", BIG):
        mail.readable_texts(odd)
        pages.features(odd)


def test_damaged_pages_take_linear_time():
    import time

    began = time.time()
    for odd in ("<!-- " * 60_000, "<script>" * 60_000, "<a href=" * 60_000, "<p" * 100_000, "<b>" * 100_000, "&" * 200_000, "http://" * 50_000, "- " * 100_000, "--q\n" * 50_000, "On " * 80_000):
        page = message(odd, kind="text/html")
        mail.readable_texts(page)
        pages.features(page)
        pages.features(message(odd))
    assert time.time() - began < 60
    assert mail.html_to_text("<title>x</title>a<!-- b -->c<STYLE>d</style >e<blockquote>f</blockquote>g", quotes=False).split() == ["a", "c", "e", "g"]


def naive(items, w, least):
    grams = {}
    for i, t in items:
        for j in range(len(t) - least + 1):
            grams.setdefault(tuple(t[j : j + least]), set()).add(i)
    return {i for j in range(len(w) - least + 1) for i in grams.get(tuple(w[j : j + least]), ())}


def test_automaton_against_ngrams():
    rng = random.Random(4)
    for least in (2, 3, 5):
        items = [(i, [rng.choice("abc") for _ in range(rng.randrange(0, 25))]) for i in range(12)]
        items.append((99, items[0][1]))
        a = leaks.Automaton(items, least)
        for _ in range(60):
            w = [rng.choice("abcd") for _ in range(rng.randrange(0, 40))]
            assert set(a.spans(w)) == naive(items, w, least)


def test_leaks_through_encodings(spark):
    passage = "every gate was final and the orchard did not notice our narrow bridge behind another lantern today"
    w = passage.split()
    quoted = "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4))
    html = "<html><p>" + " <b>".join(w).replace("<b>", "<b>x</b>"[:3]) + "</p></html>"
    docs = [(1, message(passage.upper())), (2, message(quoted)), (3, message(base64.b64encode(passage.encode()).decode(), encoding="base64")), (4, message(html, kind="text/html")), (5, message(", - ".join(w[:12]))), (6, message(" ".join(w[:11]))), (7, None), (8, ""), (9, message(" ".join(w[:6]) + " stop " + " ".join(w[6:]))), (10, message(BIG + passage)), (1, message(passage))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, "Read this: " + passage), (8, passage), (9, None), (10, "short")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted(map(tuple, leaks.leaks(d, items).collect()))
    assert got == [(i, k) for i in (1, 2, 3, 4, 5, 10) for k in (7, 8)]
    p = leaks.leaked_passages(d, items).where("doc_id = 10 and item_id = 8").first()
    assert p.action == "cut span" and p.longest == len(w) and p.item_cover == 1.0
    assert leaks.leaks(d.limit(0), items).count() == 0 and leaks.leaks(d, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    texts = [" ".join(f"w{i}x{j}" for j in range(15)) for i in range(5)]
    d = spark.createDataFrame([(i, message(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert sorted(map(tuple, leaks.leaks(d, items).collect())) == [(i, i) for i in range(5)]


def test_long_items_are_matched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 40)
    long = [f"w{i}" for i in range(150)]
    d = spark.createDataFrame([(i, message(f"so it was {i} " + " ".join(long[i : i + 12]) + " and no more")) for i in range(0, 139)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    assert leaks.leaks(d, items).count() == 139


def test_cut_leaves_what_lies_between(spark):
    a, b = " ".join(f"a{i}" for i in range(14)), " ".join(f"b{i}" for i in range(13))
    between = "The harbor, as it was İn May, did not change — and the Äpfel stayed where they were. " * 4
    text = f"Before: {a.upper()}.\n{between}{b}, {a} after it. Many more words are here so that the greater part of this part stays, as it must. " + between
    d = spark.createDataFrame([(1, message(text)), (2, message(a + " only")), (3, message("clean text")), (1, message("another text")), (4, None)], "doc_id long, text string").withColumn("part", F.lit("clash"))
    items = spark.createDataFrame([(7, a), (8, b)], "item_id long, text string")
    spans = {(r.item_id, r.first_word, r.last_word) for r in leaks.leaked_passages(d, items).where("doc_id = 1").collect()}
    n = len(mail.words(f"Before: {a} {between}"))
    assert spans == {(7, 1, 14), (8, n, n + 12), (7, n + 13, n + 26)}
    out = sorted((r.doc_id, r.part, r.text, r.removed_words) for r in leaks.without_leaks(d, items).collect())
    kept = text.replace(a.upper(), "").replace(f"{b}, {a}", ", ")
    assert [x[:2] + x[3:] for x in out] == [(1, 0, 41), (1, 0, 0), (3, 0, 0)]
    assert out[0][2].strip() == kept.strip()
    # nothing leaks any more, and nothing else is gone
    again = spark.createDataFrame([(x[0], message(x[2])) for x in out], "doc_id long, text string")
    assert leaks.leaks(again, items).count() == 0 and leaks.without_leaks(d.limit(0), items).count() == 0


def brute_best_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room, b) for b, room in enumerate(left) if room >= sizes[i]]
        if fits:
            room, b = min(fits)
            left[b] -= sizes[i]
        else:
            b = len(left)
            left.append(capacity - sizes[i])
        out[i] = b
    return out, sorted(left)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_best_fit_against_search(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        sizes = [rng.randrange(0, capacity + 1) for _ in range(rng.randrange(0, 60))]
        bins = packing.best_fit(sizes, capacity)
        left = [capacity] * (max(bins, default=-1) + 1)
        for s, b in zip(sizes, bins):
            left[b] -= s
        assert min(left, default=0) >= 0 and sorted(left) == brute_best_fit(sizes, capacity)[1]


def test_packing_is_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 50)
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 5, 100, 700, 1000, 2048, 2049, 5000])) for i in range(200)] + [(500, None), (501, 3), (501, 3)]
    d = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("piece", F.lit("clash"))
    out = packing.pack(d).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 2048
    total = out.groupby("doc_id").n_tokens.sum()
    assert all(total[i] == (n or 0) for i, n in sizes if i != 501) and total[501] == 6 and len(out[out.doc_id == 501]) == 2
    assert all((out[out.doc_id == i].piece.count() == 1) == (n <= 2048) for i, n in sizes if n is not None and i != 501)
    assert len(out.container_id.unique()) <= sum(n or 0 for _, n in sizes) / 2048 * 1.1 + 3
    assert packing.pack(d.limit(0)).count() == 0


@pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="no tokenizer files")
def test_token_counts():
    assert packing.count_tokens(None) == packing.count_tokens("") == 0
    for text in ("a" + " " * 3000 + "b c", " \n" * 1500, "x" + "\n" * 2000 + "y" + "\t " * 1000, " " * 1200 + "1"):
        assert packing.count_tokens(text) == len(packing.tokenizer(packing.TOKENIZER).encode_ordinary(text))
    assert packing.count_tokens(" " * 2_000_000 + "x") > 0
    assert packing.count_tokens("hello world") == 2 and packing.count_tokens(BIG) >= 20_000


def test_copies(spark):
    rows = [(1, "a-b", "M 1", "x = {1}"), (2, "A_B", "m1", "X={ 1 }\n"), (3, "ab", "m1", "1x"), (4, None, None, None), (5, None, None, None), (6, "ab", "m1", ""), (7, "ab", "m1", None), (8, "ab1", "m", "x1"), (9, "Ünï", "m", BIG), (10, "ÜNÏ", "M", BIG.replace(" ", "--"))]
    d = spark.createDataFrame(rows, "id long, a string, b string, c string").withColumn("record_id", F.lit("clash")).withColumn("first_id", F.lit(0))
    got = {r.record_id: (r.first_id, r.copies) for r in copies.hidden_copies(d, "id", ["a", "b", "c"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 2), 7: (6, 2), 8: (8, 1), 9: (9, 2), 10: (9, 2)}
    assert copies.hidden_copies(d.limit(0), "id", ["a", "b", "c"]).count() == 0


def test_predictions_of_all_shapes(spark):
    rows = [(1, '{"i": {"instance_id": "i", "model_name_or_path": "m", "model_patch": "P 1"}}'), (2, "{'i': {'model_patch': 'p1', 'instance_id': 'I', 'model_name_or_path': 'M'}}"), (3, "{"), (4, None), (5, "[]"), (6, '{"i": {}}'), (None, "{}")]
    d = spark.createDataFrame(rows, "pred_id long, pred_json string")
    got = {r.pred_id: r.first_id for r in copies.prediction_copies(d).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == 4 and got[5] == 5 and len(got) == 6


PROSE = "The harbor was calm and we did not repair the bridge. They will finish the market before noon. Could you check this gate?"


def pages_frame(spark):
    heap = "Tags: " + "; ".join(f"cheap-w{i}" for i in range(80))
    links = "\n".join(f"{i}. word{i} - http://shop{i}.example/a{i}" for i in range(30))
    stuffed = " ".join(["watches deals casino replica"] * 60)
    docs = [(i, message(PROSE + f" It was {i}."), "a@good.example") for i in range(40)] + [(100 + i, message([heap, links, stuffed][i % 3] + f" x{i}"), None if i % 2 else "b@bad.example") for i in range(12)]
    docs += [(112, message("Dear list,\n\n" + "mortgage ulelsha online! " * 40), "c@bad.example"), (204, message("\n".join(f"The nightly job stopped at 10:{i} with code 0." for i in range(10, 40))), "q@good.example")]
    docs += [(200, None, None), (201, "", "x"), (202, message(PROSE + "\nhttp://a.example/b\n" + PROSE), "q@good.example"), (203, message("\n> ".join(["> " + heap] * 3) + "\n\n" + PROSE), "q@good.example"), (100, message(heap), "z")]
    return spark.createDataFrame(docs, "doc_id long, text string, sender string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(1))


def test_stuffed_pages(spark):
    d = pages_frame(spark)
    assert sorted(r.doc_id for r in spam.stuffed_pages(d).collect()) == sorted([*range(100, 113), 100])
    assert spam.score_pages(spam.page_features(d)).count() == d.count()


def test_trees_decide_and_hosts_smooth(spark):
    """Pages that the rules leave unlabelled are decided by the trees; a host's other pages move a score by their rate."""
    d = pages_frame(spark)
    pages_ = spam.page_features(d).withColumn("weak", spam.weak_label()).cache()
    s = spam.score_pages(pages_.drop("weak")).join(pages_.select("doc_id", "weak"), "doc_id").cache()
    assert {(r.weak, r.page_score >= 0.5) for r in s.where("weak is not null").collect()} == {(0, False), (1, True)}
    rates = {r.host: r.host_rate for r in s.collect()}
    assert rates["bad.example"] > rates["good.example"]
    assert all(abs(r.score - 0.8 * r.page_score - 0.2 * r.host_rate) < 1e-9 for r in s.collect())
    assert all(r.page_score == 0 for r in s.where("doc_id in (200, 201)").collect())


def test_stuffed_pages_with_one_label_or_none(spark):
    d = pages_frame(spark)
    assert spam.stuffed_pages(d.where("doc_id < 40")).count() == 0
    assert spam.stuffed_pages(d.where("doc_id between 101 and 112")).count() == 12
    assert spam.stuffed_pages(d.limit(0)).count() == 0
