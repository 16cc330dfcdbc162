"""Inspected examples: what each style of text looks like and of which kind it is.

Styles were found by looking through the corpus; their examples are written here by rule, in several lengths each, with
words of our own.
"""

from __future__ import annotations

import base64
import random

NOUNS = "lamps rafts kettles ropes ladders mirrors wagons baskets anchors stoves looms bridges canoes lanterns sleds pumps".split()
ADJECTIVES = "wooden northern spare heavy copper woven coastal folding painted winter river mobile".split()
VERBS = "clean repair stack count paint carry label weigh inspect rinse sort store".split()
PLACES = ["at the harbour", "in the barn", "near the mill", "on the north pier", "under the bridge", "during the winter"]
PROSE = {
    "en": [
        "The crew of the northern mill checks the copper kettles every morning and notes in the log what has to be repaired.",
        "When the river rises, the wagons are moved to the upper barn so that nothing gets wet, which takes about an hour.",
        "Members who repair looms must hold a valid certificate and have worked with folding ladders for 12 months.",
        "Provides estimates for ropes, lamps and other spare equipment and advises the keeper on the state of the bridges.",
        "Does anybody know how the harbour team is supposed to store the winter sleds?",
        "Please make sure that you count the baskets before the evening shift leaves!",
        "I have been painting lanterns near the mill for 3 years now, and it is still a pleasure.",
        "Reads drawings, tables and Fig. 4 of the manual in order to weigh the anchors with care.",
        "Finds out whether winter rafts need new ropes, planks or further care to serve the keepers well.",
        "Shows 12 newly hired hands how to mend nets, rig sails and handle copper stoves.",
        "Settles disputes between the north pier and the mill before lending wagons or sleds.",
        "The west shift keeps e.g. 14 crates of mirrors ready in the barn.",
    ],
    "de": [
        "Die Mannschaft der Mühle prüft jeden Morgen die Kessel und schreibt in das Buch, was noch zu reparieren ist.",
        "Wenn der Fluss steigt, werden die Wagen in die obere Scheune gebracht, damit nichts nass wird.",
        "Es ist wichtig, dass alle Leitern vor der Schicht gezählt und die Mängel sofort gemeldet werden.",
    ],
    "fr": [
        "L’équipe du moulin vérifie chaque matin les chaudrons et note dans le cahier ce qui doit être réparé.",
        "Quand la rivière monte, on déplace les chariots dans la grange pour que rien ne soit mouillé.",
        "Nous avons compté 14 paniers près du pont et il en manque encore deux pour la semaine.",
    ],
    "es": [
        "El equipo del molino revisa las calderas cada mañana y anota en el libro lo que se debe reparar.",
        "Cuando sube el río, los carros se llevan al granero de arriba para que no se moje nada.",
        "Hemos contado 14 cestas cerca del puente y todavía faltan dos para esta semana.",
    ],
}


def _wrap(text: str, width: int) -> str:
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def _varied(rng: random.Random, sentence: str) -> str:
    """The sentence with half of its longer words exchanged for invented ones, as running text doesn't say the same twice."""
    word = lambda n: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"]) for _ in range(max(2, n // 3)))
    return " ".join(word(len(w)) if len(w) > 5 and w.isalpha() and rng.random() < 0.5 else w for w in sentence.split())


def _prose(rng: random.Random, n: int, lang: str) -> str:
    first = rng.sample(PROSE[lang], min(n, len(PROSE[lang])))
    return " ".join(first + [_varied(rng, rng.choice(PROSE[lang])) for _ in range(n - len(first))])


def _entry(rng: random.Random) -> str:
    kind = rng.random()
    noun = rng.choice(NOUNS)
    if kind < 0.35:
        return noun
    if kind < 0.6:
        return f"{rng.choice(ADJECTIVES)} {noun}"
    if kind < 0.8:
        return f"{rng.choice(VERBS)} {rng.choice(ADJECTIVES)} {noun}"
    return f"{rng.choice(VERBS)}ing {rng.choice(ADJECTIVES)} {noun} {rng.choice(PLACES)}"


def _row(rng: random.Random, kinds: list[int]) -> list[str]:
    cells = [
        lambda: rng.choice(NOUNS), lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 9)}", lambda: f"20{rng.randint(10, 24)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: rng.choice(["open", "closed", "", "n/a"]),
        lambda: f"{rng.randint(1, 6)}{rng.choice('ABC')}{rng.randint(0, 9)}X{rng.randint(1, 3)}", lambda: str(rng.randint(1, 999)), lambda: rng.choice(["east", "pier 2", "barn"]), lambda: rng.choice(["None.", "See the note of the keeper.", f"Counts {rng.choice(NOUNS)} {rng.choice(PLACES)}."]),
    ]
    return [cells[k]() for k in kinds]


def _table(rng: random.Random, rows: int, style: str, remark: bool) -> str:
    kinds = rng.sample(range(7), rng.randint(3, 5)) + [7] * remark
    head = [["item", "hours", "due", "status", "code", "qty", "site", "remark"][k] for k in kinds]
    all_rows = [head, *(_row(rng, kinds) for _ in range(rows))]
    if style == "pipe":
        out = ["| " + " | ".join(r) + " |" for r in all_rows]
        out.insert(1, "|" + " --- |" * len(kinds))
    elif style == "box":
        rule = "+" + "--------------+" * len(kinds)
        out = [rule, "|" + "|".join(c.ljust(14) for c in head) + "|", *("|" + "|".join(c.ljust(14) for c in r) + "|" for r in all_rows[1:]), rule]
    elif style == "columns":
        out = ["".join(c.ljust(14) for c in r) for r in all_rows]
    elif style == "quoted":
        out = [";".join(f'"{c}"' for c in r) for r in all_rows]
    else:
        out = [style.join(r) for r in all_rows]
    return ("Summary by barn\n" if rng.random() < 0.3 else "") + "\n".join(out)


def _list(rng: random.Random, n: int, style: str) -> str:
    items = [_entry(rng) for _ in range(n)]
    if style == "run":
        body = ", ".join(items) + "."
    elif style == "numbered run":
        body = " ".join(f"{i}) {x};" for i, x in enumerate(items, 1))
    else:
        marks = {"dash": lambda i: "- ", "dot": lambda i: "• ", "circle": lambda i: "o ", "nested": lambda i: rng.choice(["    - ", "  + ", "•\t", "+ "]), "box": lambda i: rng.choice(["[ ] ", "[x] "]), "number": lambda i: f"{i}. ", "paren": lambda i: f"{i}) ", "letter": lambda i: f"{chr(97 + i % 26)}) ", "decimal": lambda i: f"2.{i}. "}
        mark = marks.get(style, lambda i: "")
        stop = rng.choice(["", "", ".", ";"])
        page = (lambda i: " " + "." * rng.randint(8, 30) + f" {i}") if style == "contents" else (lambda i: stop)
        body = "\n".join(mark(i) + x.capitalize() + page(i) if rng.random() < 0.5 else mark(i) + x + page(i) for i, x in enumerate(items, 1))
    lead = rng.random()
    return ("Needed:\n" if lead < 0.3 else rng.choice(PROSE["en"][:4]) + "\n" if lead < 0.45 else "") + body


def _broken(rng: random.Random, text: str, share: float) -> str:
    return "".join(rng.choice("|!~.,01Il" + "acefimnrt") if c.isalpha() and rng.random() < share else c for c in text)


def _junk(rng: random.Random, style: str, n: int) -> str:
    if style == "encoded":
        raw = base64.b64encode(rng.randbytes(n)).decode()
        return "\n".join(raw[i : i + 76] for i in range(0, len(raw), 76))
    if style == "hex":
        return "\n".join(f"{i * 16:08x}  " + " ".join(f"{b:02x}" for b in rng.randbytes(16)) for i in range(n // 40 + 2))
    if style == "markup":
        return "".join(f'<{t} id="{rng.randint(1, 999)}"></{t}>' for t in rng.choices(["div", "span", "td", "br"], k=n // 20 + 3))
    if style == "symbols":
        return "".join(rng.choice(r"|/\-_~^*.,:;'`=■□iIl1 ") for _ in range(n))
    if style == "letters":
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 13))) for _ in range(n // 8))
    if style == "codes":
        return " ".join(f"{rng.choice('KJQWXZ')}{rng.randint(1000, 99999)}{rng.choice(['', '$$', '#', '%', '&'])}" for _ in range(n // 7))
    if style == "one word":
        return " ".join([rng.choice(NOUNS)] * (n // 7))
    if style == "one sentence":
        return (" " if n % 500 else "\n").join([rng.choice(PROSE["en"])] * (n // 100 + 4))
    if style == "one mark":
        return rng.choice("=-_*.") * n
    if style == "page parts":
        return "\n".join(rng.choice(["Share", "Home >", "Next >>", "<< Back", "Login", "(c)", "[...]", "Top", "Skip", "Print"]) for _ in range(n // 7))
    if style == "wrong encoding":
        return "".join(rng.choice(["Ã©", "â€™", "Â ", "�", "Ã¼", " ", rng.choice("aeinrst")]) for _ in range(n // 2))
    text = _prose(rng, n // 100 + 1, rng.choice(["en", "de", "fr"]))
    return _broken(rng, text, 0.18 if style == "broken" else 0.4)


def examples(seed: int = 11) -> list[tuple[str, str, str]]:
    """(style, kind, text) of all examples; the same ones on every call."""
    rng = random.Random(seed)
    out: list[tuple[str, str, str]] = []
    for lang in PROSE:
        out += [(f"prose short {'en' if lang == 'en' else 'other'}", "prose", s) for s in PROSE[lang]]
        for style, n in (("short", 2), ("plain", 5), ("plain", 9), ("plain", 16), ("long", 60), ("wrapped", 6), ("wrapped", 14), ("headed", 4), ("headed", 10), ("lines", 8), ("answers", 8)):
            for _ in range(3 if lang == "en" else 1):
                text = _prose(rng, n, lang)
                if style == "wrapped":
                    text = _wrap(text, rng.choice([48, 60, 72, 90]))
                elif style == "headed":
                    text = f"{rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}".title() + "\n\n" + text
                elif style == "lines":
                    text = "\n".join(_prose(rng, 1, lang) for _ in range(n))
                elif style == "answers":
                    text = "\n".join(f"{m}: {_prose(rng, 2, lang)}" for m in ("Q", "A", "Q", "A"))
                out.append((f"prose {style} {'en' if lang == 'en' else 'other'}", "prose", text))
        for n, k in ((5, 3), (8, 4), (14, 6), (24, 8)):
            for where in range(3 if lang == "en" else 1):
                parts = [_prose(rng, n // 2, lang), "\n".join("- " + _entry(rng) for _ in range(k)) if where < 2 else _table(rng, k // 2, "pipe", False), _prose(rng, n - n // 2, lang)]
                out.append((f"prose around {'en' if lang == 'en' else 'other'}", "prose", "\n\n".join(parts)))
    for style in ("pipe", "box", "columns", "quoted", "\t", ","):
        for rows in (4, 8, 14, 25, 40):
            for remark in (False, True):
                out.append((f"table {style}{' with remarks' * remark}", "table", _table(rng, rows, style, remark)))
    for style in ("dash", "dot", "circle", "nested", "box", "number", "paren", "letter", "decimal", "bare", "contents", "run", "numbered run"):
        for n in (6, 12, 24, 40):
            for _ in range(2):
                out.append((f"list {style}", "list", _list(rng, n, style)))
    for style in ("encoded", "hex", "markup", "symbols", "letters", "codes", "one word", "one sentence", "one mark", "page parts", "wrong encoding", "broken", "wrecked"):
        for n in (250, 600, 1000, 2000, 2500):
            out.append((f"junk {style}", "junk", _junk(rng, style, n)))
    return out
