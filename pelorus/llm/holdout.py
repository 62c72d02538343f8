"""A small holdout, written and labelled by hand: 1 for lists, tables and junk, 0 for prose."""

from __future__ import annotations

_PROSE = (
    "Mr Speaker, the committee has read the petition twice and finds that the road to the mill is not safe in winter. "
    "We ask the government to say by the end of the month what it means to do, and what it will cost.",
    "La commission a examiné le projet avec soin. Elle demande au ministre de dire, avant la fin de la session, "
    "pourquoi les travaux du quai ont été remis à l'an prochain.",
    "Wir haben den Antrag geprüft und halten ihn für richtig. Die Gemeinde braucht eine neue Brücke, und sie braucht "
    "sie nicht erst in zehn Jahren.",
    "El puerto no puede esperar más. Los vecinos han pedido una respuesta clara, y el ministro ha contestado que se "
    "estudiará el caso durante el verano.",
    "THE HOUSE WILL COME TO ORDER. THE MEMBER HAS THE FLOOR AND WILL BE HEARD IN SILENCE. I SHALL NOT SAY IT AGAIN.",
    "I thank the member for the question.\n\nThe answer is that 14 schools were opened in 1998, 9 in 1999 and none since. "
    "That is a poor record, and the minister knows it.\n\nWe shall return to the matter on Tuesday.",
    "The member asked me\nwhether the ferry would run\nin January, and I said that\nit would if the ice allowed,\nbut that I could not promise it.",
    "> The letter says that the bridge\n> was closed without notice, and that\n> nobody at the office could tell the\n> drivers when it would be open again.",
    "It is a question of trust. (Applause.) When a board tells a village that its clinic will stay, and then shuts it in "
    "the same year, [Hon. Members: Shame!] nobody will believe the next promise.",
)
_SHORT = ("No.", "Oui.", "Hear, hear!", "Ich bin dagegen.", "Aprobado.", "Order, order.", "(Laughter.)", "Agreed to.", "ORDER!")
_ODD = (
    "| year | boats | crew |\n|---|---|---|\n| 1998 | 41 | 230 |\n| 1999 | 38 | 214 |\n| 2000 | 44 | 251 |\n| 2001 | 47 | 260 |",
    "school\t12\t4.5\t88\nclinic\t3\t1,5\t17\nquay\t9\t2.25\t41\nmill road\t5\t7\t39\nlighthouse\t1\t0.5\t2",
    "harbour office       1200     340.5     77\nmill road             981      12.0      4\nclinic               4410     220,5     19",
    "1998;quay;440\n1999;quay;512.5\n2000;mill;77\n2001;mill;93\n2002;clinic;1020",
    "* nets\n* rope\n* lamp oil\n* tar\n* two boats\n* salt\n* oars\n* spare sails",
    "- roads\n- bridges\n- wells\n- schools\n- clinics\n- the mill",
    "1. Reading of the minutes\n2. Petitions\n3. Second reading of the Fisheries Bill\n4. Motion on roads\n5. Any other business",
    "NOES\nAlder, Tom\nBirk, Anna\nCole, Ruth\nDahl, Per\nEly, Joan\nFinch, Sam\nGrey, Max",
    "Fisheries Bill ........................ 12\nMotion on Roads ................... 19\nPetitions ........... 27\nEstimates ................... 31",
    "QmFzZTY0IGlzIG5vdCBwcm9zZSBhbmQgbmV2ZXIgd2FzLCBzbyBpdCBtdXN0IGJlIHNl\nZW4gYXMganVuayBieSBhbnkgZml0dGVkIG1vZGVsIHRoYXQgbG9va3MgYXQgaXQu",
    "<div><table><tr><td>quay</td><td>17</td></tr><tr><td class=\"a\">mill</td><td>9</td></tr></table></div><p id=\"x\"></p>",
    "page page page page page page page page page page page page page page page page page page page page",
    "... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ...",
    "■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■ ■",
    "th3 q~u!c /k br0 }wn f% o:x j^u m=p s ov {er l|a zy d0 <g xq 9#k vv }t p@ l; wn ~e r] z o/ x& k!t q",
    "2017-01-02T10:11:12Z WARN pool-3 retry=4 id=9f8e7d6c5b4a39281706f5e4d3c2b1a0 host=a1.example:8080\n"
    "2017-01-02T10:11:13Z WARN pool-3 retry=5 id=0a1b2c3d4e5f60718293a4b5c6d7e8f9 host=a1.example:8080",
)


def taught_texts() -> list[tuple[str, int]]:
    """(text, 1 for junk or 0 for prose) to learn from whatever the corpus: every other plain case."""
    return [(t, 0) for t in (*_PROSE[::2], *_SHORT[::2])] + [(t, 1) for t in _ODD[::2]]


def checked_texts() -> list[tuple[str, int]]:
    """(text, 1 for junk or 0 for prose) to calibrate by: the other plain cases, then prose and tables mixed both ways."""
    out = [(t, 0) for t in (*_PROSE[1::2], *_SHORT[1::2])] + [(t, 1) for t in _ODD[1::2]]
    for i, odd in enumerate(_ODD):
        prose = _PROSE[i % len(_PROSE)]
        some, much = prose, odd
        while len(some) < 3 * len(odd):
            some += "\n\n" + _PROSE[(i + len(some)) % len(_PROSE)]
        while len(much) < 3 * len(prose):
            much += "\n" + odd
        out += [(f"{some}\n\n{odd}", 0), (f"{prose}\n\n{much}", 1)]
    return out


#: Documents of the test tables of scale 0.1, drawn at random (24), and among the short, the broken into lines and those in capitals (40),
#: and read one by one: more than half a list, a table or junk, or prose. Only their numbers; the texts are in the tables.
DRAWN_JUNK = (
    3897, 8203, 40, 8146, 2830, 5268, 6234, 1423, 1353, 6581, 1137, 3893, 8851, 5023,
)
DRAWN_PROSE = (
    4141, 5340, 3233, 3941, 3165, 1886, 4790, 7803, 9141, 2384, 9108, 4587, 465, 3134, 8312, 6367, 2997, 5432, 2266, 1653,
    9788, 4907, 9514, 8647, 3665, 4107, 2739, 1041, 1163, 2854, 9852, 7946, 8419, 9945, 7642, 1096, 9997, 3037, 4692, 1258,
    8161, 7632, 1537, 6333, 7825, 1751, 7819, 775, 5674, 8798,
)
