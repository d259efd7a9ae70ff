"""Stuffed pages: the automaton against brute force, kinds of pages, awkward inputs."""

import random
from collections import defaultdict

import numpy as np

from matchweft.llm import stuffing
from matchweft.llm.automaton import Order, ending_order, repeated_states
from matchweft.llm.stuffing import is_stuffed, page_scores, stuffed_pages

SPAM = [
    "rank guide Tarthal codes Tarthal delivery guide Tarthal codes guide rank codes Bruthal rank rank Bruthal guide delivery Bruthal rank",
    "https://quinowinbuy92.example/pale-hook/buy\n* https://ostkesscheap18.invalid/fog-mantle\n* http://a.test/b\n[here](https://x.test/y) coins best",
    "Grodra top for sale. Cheap Grodra top here. Order Grodra top now! Grodra top, more Grodra top and only Grodra top. Buy Grodra top. Where to get Grodra top.",
    "#glassanchor #sofort #ikmirr #varowin #hulkess #tincrown #fenmirr #inktalisman #thorndial",
    "t@g:reedfolk t@g:d1scount t@g:copperve1l t@g:t1debound t@g:groth@l t@g:v@row1n t@g:fr33",
    "Cinder Loop poster - 7.41 - comprar, guía, descuento • Reed Whistle skin - 17.33 - descuento, gratis • Fog Mantle pack - 16.00 - rango",
    "fenthal, ostowin, seldra, brukess, tardra, tardra, varkess, nykess, guide, emberkin, fendra, inktalisman, nightledger",
    "Brudra fr33 > S3lk3ss fr33 > S3low1n t13r l1st > Nyow1n t13r l1st > Groow1n t13r l1st > Hulk3ss fr33",
]
FINE = [
    "p4: rip\np8: 20 gold, greedy\np4: wait what\np6: 67 gold, greedy\np5: Quinowin again\np8: 4 gold, greedy\np1: go level 7\np8: same",
    "[2-2] hp_changed 2 -> 6\n[2-6] equip_item Twin Spool on Fenthal\n78.5 refresh_shop gold=78 slots=5\n{\"kind\":\"gold\",\"value\":{\"gold\":7}}",
    "Every empty timer followed every plan. The left opponent had three copies of Fendra, as far as the video shows. Their stubborn position weakened Copper Veil.",
    "Wie so oft war der Laden zweimal leer, und damit war es entschieden. Mit 15 Gold kam Stufe 9 eine Runde zu spät. Leider war der Laden zweimal leer.",
    "골드 26개로 레벨 7이 너무 늦게 왔다. 그래서 졌다. 레벨 4이 너무 늦게 왔다. Melmirr을 뒤에 두고 Hulkess에게 Rust Harp을 주었다.",
    "6-7で、店の読み取りが56秒止まった！5-6で、Brukessは誰も欲しがらなかった。それで負けた。\nhttps://notes-a.example/",
    "My bench ruined no angle right at my interest, so the tempo left that shop.\nhttps://notes-emberkin.example/a",
    "ok", "7", "", " \n ", None, "zZ9+/kQ=" * 40, "​" * 50, "." * 400,
]


def test_kinds_of_pages():
    for text in SPAM:
        assert is_stuffed(text), (page_scores([text or '']), text)
    for text in FINE:
        assert not is_stuffed(text), (page_scores([text or '']), text)


def test_most_of_the_text_decides():
    assert is_stuffed(SPAM[0] + "\nNobody contested the bench.") and not is_stuffed(SPAM[1] + "\n" + "\n".join(FINE[2:3] * 3))


def _classes(text: str) -> dict[tuple[int, ...], int]:
    """Length of the longest substring of each class that ends at the same places."""
    ends = defaultdict(list)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            ends[text[i:j]].append(j - 1)
    out: dict = {}
    for part, at in ends.items():
        out[tuple(at)] = max(out.get(tuple(at), 0), len(part))
    return out


def test_states_equal_brute_force():
    rng = random.Random(8)
    for turn in range(150):
        texts = ["".join(rng.choice("ab" if turn % 2 else "abc") for _ in range(rng.randrange(26))) for _ in range(rng.randrange(4))]
        least, times = rng.randrange(1, 4), rng.randrange(2, 6)
        starts = np.cumsum([0, *map(len, texts)])[:-1].astype(int)
        order = ending_order(np.array([ord(c) for t in texts for c in t], np.int64), starts)
        got = repeated_states(order, least, times)
        found = sorted(zip(got.length.tolist(), got.count.tolist(), got.first.tolist(), got.last.tolist()))
        wanted = sorted((n, len(at), at[0] + s, at[-1] + s) for t, s in zip(texts, starts) for at, n in _classes(t).items() if n >= least and len(at) >= times)
        assert found == wanted
        for n, count, low, high in zip(got.length, got.count, got.low, got.high):
            assert high - low == count and (order.shared[low + 1 : high] >= n).all()


def test_without_the_automaton_nothing_is_found(monkeypatch):
    flat = lambda codes, starts: Order(np.arange(len(codes)), np.zeros(len(codes), np.int64))
    monkeypatch.setattr(stuffing, "ending_order", flat)
    assert not any(map(is_stuffed, SPAM))


def test_batches_do_not_mix():
    texts = [t or "" for t in SPAM + FINE]
    together = page_scores(texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], page_scores([t])[0])


def test_table_with_awkward_rows(spark):
    rows = [(i, t, 1.0) for i, t in enumerate(SPAM + FINE)] + [(0, SPAM[0], 1.0), (None, SPAM[1], 1.0), (99, SPAM[0] * 2000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    got = [r["doc_id"] for r in stuffed_pages(df).collect()]
    assert sorted(x for x in got if x is not None) == sorted([*range(len(SPAM)), 0, 99]) and got.count(None) == 1
    assert stuffed_pages(df.limit(0)).count() == 0
