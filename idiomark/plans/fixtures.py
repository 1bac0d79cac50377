"""Literal rows for what the test tables never show: probes, dictionary pages, articles, a mutation session."""

from __future__ import annotations

#: (want, name, text); both sides of each threshold and rule.
PROBES = [
    (True, "one decisive marker", "Mir hei gäng Zyt für das."),
    (True, "decisive at the end", "So öppis!"),
    (True, "derived plural", "Die Sitzige si churz."),
    (True, "derived twin", "Chöi mir das mitenang luege?"),
    (True, "prefix and participle", "I ha das ufgschribe."),
    (False, "prefixed, but too short", "agnu igha"),
    (True, "productive ending", "Das isch würklech fründlechi Arbeit."),
    (False, "endings of other words", "Das Schutzblech ist schlecht, ein Cromlech auch."),
    (True, "two supporting, one not weak", "Er het das nid."),
    (False, "one supporting", "Mir luege zu."),
    (True, "three weak in lower case", "nit gsi, gha"),
    (False, "two weak in lower case", "gsi und gha"),
    (False, "weak ones as acronyms", "The GSI, the GHA and the NIT"),
    (False, "one marker, often", "het, het und het"),
    (True, "capital at the start of a sentence", "Gut. Chum, luege mer."),
    (False, "capital within a sentence", "mit dem Chum luege"),
    (True, "capital after a line end, grounded", "Salü\nChum, mir luege."),
    (False, "capitals after line ends alone", "Modi\nCha\nWitt"),
    (True, "after an opening quote", "«Chum, mir luege.»"),
    (False, "inside identifiers", "x_isch_y 3isch isch/gsy isch+a"),
    (False, "inside addresses", "a@isch.ch https://gsy.example/isch pod-isch-7 www.isch.ch"),
    (True, "elision", "Was hesch's gseit?"),
    (True, "escapes are white space", "geng\\nluege\\tscho"),
    (True, "decomposed", "o\u0308ppis"),
    (True, "a decomposed word among composed ones", "Das isch a\u0308be o\u0308ppis"),
    (True, "with an emoji", "So öppis! \U0001f642"),
    (True, "with a dash", "So öppis \u2013 gäll"),
    (True, "with curly quotes", "\u201cSo öppis\u201d, het\u2019s gheisse"),
    (False, "an emoji in English", "Well done \U0001f642 \u2014 thanks"),
    (False, "a cased decisive marker as an acronym", "Ask ITZ about it."),
    (True, "the same in lower case", "chum itz"),
    (False, "plain English", "Please review the deployment of the new service."),
    (False, "plain German", "Die Migration ist im Gange, zwei Modi stehen bereit."),
    (False, "empty", ""),
]
PROBE_CERTAIN = [(True, "decisive", "So öppis!"), (False, "supporting only", "Er het das nid.")]
TRIAL_PROBES = [
    (True, "two supporting", "the thing and that"),
    (False, "weak only", "the thing of and"),
    (True, "cased at the start", "Por la tarde"),
    (False, "cased within", "la Por tarde"),
]

_LETTERS = "lorem ipsum dolor sit amet consectetur adipiscing elit "
#: Long texts around the window's cuts.
LONG = [("bare", _LETTERS * 400), ("marker first", "gäng " + _LETTERS * 900), ("marker last", _LETTERS * 900 + " gäng"), ("marker inside", _LETTERS * 200 + " gäng " + _LETTERS * 200), ("no space", "verzeichnisch" * 3000), ("decomposed", "a\u0308" * 9000 + " ga\u0308ng " + "x" * 9000), ("emoji", "\U0001f642 gäng " + _LETTERS * 900 + "\u2019gäng\u2019")]

_HIT = '<h3><a href="https://x.example/words/{}?q=1">{}</a> <small>{}</small></h3>{}{}'


def _hit(n, word, pos="[Adj.]", alt=None, gloss=None):
    return _HIT.format(n, word, pos, f"<h5>Schreibweisen: {alt}</h5>" if alt else "", f'<p class="hidden-xs">{gloss}</p>' if gloss else "")


def _page(*hits, pages=1, footer="<footer>suber</footer>"):
    links = "".join(f'<a href="?q=x&amp;page={i}">{i}</a>' for i in range(2, pages + 1))
    return "<html><body>" + "\n".join(hits) + links + footer + "</body></html>"


#: (query, page_no, html) of landed dictionary searches.
SEARCH = [
    ("suber", 1, _page(_hit(1, "<b>suber</b>", gloss="sauber &amp; rein"), _hit(2, "suberi", "[Adj. f.]"))),
    ("«gäng»", 1, _page(_hit(3, "gänggele", "[V.]"), _hit(4, "Gang", "[m.]"), pages=2)),
    ("«gäng»", 2, _page(_hit(5, "gäng", "[Adv.]", "geng, ging (Oberland, selten), gäng usw."))),
    ("verworgle", 1, _page(_hit(6, "verworge", "[V.]", "verworge, verworgge,. verworgle", "sich verschlucken"))),
    ("neime", 1, _page(_hit(7, "nöime", "[Adv.]", "Stadt Bern: neime; Oberland niene"))),
    ("nöd", 1, _page(_hit(8, "nid", "[Adv.]"), _hit(9, "nit", "[Adv.]"), _hit(10, "nüt", "[Pron.]"))),
    ("hus", 1, _page(*[_hit(20 + i, f"Husli{i}", "[n.]") for i in range(8)], pages=40)),
    ("arbeitendi", 1, _page(_hit(40, "(Mit)arbeitendi", "[f. Pl.]"))),
    ("sech", 1, _page(_hit(41, "gfreue, sech", "[V.]"))),
    ("tägli", 1, _page(_hit(42, "Tag", "[m., Pl. Täg, Dim. Tägli n]"))),
    ("kaputt", 1, None),
]

_BERN = "D Lüt hei gäng öppis z tüe, u viu isch äbe nid so wie mes wott. "
_OTHER = "Mir händ nöd Ziit, deet sinn alli bikannt gsi. "
#: (title, text)
ARTICLES = [
    ("Bern (Stadt)", _BERN * 20),
    ("Bern-Stadt", _BERN * 19 + _OTHER),
    ("Bern  Stadt", _BERN * 18),
    ("bern (stadt)", _BERN * 21),
    ("Bern_Stadt-2", _BERN * 17),
    ("???", _BERN * 16),
    ("!!!", _BERN * 15),
    ("Totemügerli", _OTHER * 30),
    ("Neutral", "Ein Text ohne Kennzeichen, der lang genug ist. " * 20),
    ("Kurz", _BERN),
]

SOURCE = '''
import re

X = 1


def first(a):
    def inner(b):
        return b

    return inner(a)


class Box:
    def get(self):
        return 1

    async def put(self, x):
        self.x = x


def last():
    return X
'''
#: (path, body) of files, and what is measured of each: (path, text, names).
FILES = [("a.py", f"RULES = {'Regle ' * 60!r}\nSHORT = 'x'\nN = 5\nMORE = OTHER = {'gäng ' * 50!r}\n"), ("b.py", "X = 1\n"), ("c.md", "# Regle\nSchryb so.")]
MEASURED = [("a.py", "Regle " * 60 + "\n" + "gäng " * 50 + "\n" + "gäng " * 50, "RULES, MORE, OTHER"), ("b.py", "X = 1\n", None), ("c.md", "# Regle\nSchryb so.", None)]
#: (lo, hi, name) of SOURCE, as the span reader gives them.
SPANS = [(7, 11, "first"), (15, 16, "get"), (18, 19, "put"), (22, 23, "last")]
#: (job_id, start_pos_row) and (job_id, test_outcome)
SPECS = [(f"j{i:03d}", 1 + (i * 7) % 24) for i in range(60)]
RESULTS = [(f"j{i:03d}", ("KILLED", "KILLED", "SURVIVED", "KILLED", "INCOMPETENT")[i % 5]) for i in range(57)]
#: Results in which every mutant of `put` and `get` survives.
LAX = [(j, "SURVIVED" if 15 <= line <= 19 else o) for (j, line), (_, o) in zip(SPECS, RESULTS, strict=False)]
WANTED = [("first",), ("get",), ("gone",), ("last",)]

#: (session_id, turn, fire, certain)
TURNS = (
    [("two", 1, True, True), ("two", 2, True, True), ("late", 1, True, False), ("late", 2, True, True), ("late", 3, False, False), ("late", 4, True, True)]
    + [("long", t, True, True) for t in range(1, 60)]
    + [("mixed", t, t % 3 != 0, t % 2 == 0) for t in range(1, 90)]
    + [("a/b c", 1, True, True), ("a_b_c", 2, True, True), (None, 1, True, True), (None, 2, True, True), ("", 3, True, False)]
)
#: (session_id, counter stored earlier)
STATES = [("two", "3"), ("late", ""), ("long", "24"), ("mixed", "no number"), ("a_b_c", "99"), ("gone", "4")]
#: Lines of a labelled file, of a word list, and tokens for the generators.
LABELLED = [("# note",), ("",), ("bd\tchat\tHallo\\NChum\tmit Tab\\n",), ("  ",), ("xx\tlog\tplain",), (" xx \t ci \tSo öppis \u2013 gäll",)]
WORD_LINES = [("Agha",), (" isch ",), ("",), ("agha",), ("Wëllblech",)]
TOKENS = [(w,) for w in "Sitzige wohnige meinige mitenang verstange bärngütsch ufgschribe agnu würklech schlecht Fründlechi haus ufgschribe blech".split()]
EVENTS = [("{\"a\": {\"prompt\": \"x\"}, \"prompt\": 7}",), ('{"prompt": "hoi \u2013 du", "session_id": null}',), ('{"prompt": "So öppis!", "session_id": "s1"}',), ('{"prompt": "  ", "session_id": "s1"}',), ('{"prompt": 5}',), ("[1]",), ("no json",), ('{"prompt": "hoi", "session_id": 7}',), ("",), ('{"session_id": "s"}',)]
BODIES = [("good", "# Regle\nSchryb so."), ("blank", " \n\t"), ("binary", "�" * 10 + "x" * 100), ("one odd", "�" + "x" * 30)]
SESSION_IDS = [("abc-DEF_1",), ("a/b:c d",), ("ü" * 200,), ("",), (None,)]
