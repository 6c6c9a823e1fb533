"""The rewriting rules for names of people and organisations: what a spelling may stand for.

Rules are fixed knowledge of how names are written; nothing here depends on the
collection. A name is read once into a canonical key; the key's forms, its cut-down
and misread writings, follow from the key alone.
"""

from __future__ import annotations

import re
import unicodedata

# Short forms of given names, by full name; a short form may belong to several. `table` builds the same from a longer list.
NICKNAMES = {
    "abigail": "abby abbie gail", "albert": "al bert bertie", "alexander": "alex sandy", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony", "arthur": "art artie", "barbara": "barb babs bobbie",
    "benjamin": "ben benny benji", "bernard": "bernie", "bradley": "brad", "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "christine": "chris chrissy tina", "christopher": "chris", "clifford": "cliff",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donnie", "dorothy": "dot dottie", "douglas": "doug", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora",
    "elizabeth": "liz beth betty lizzie eliza bess", "eugene": "gene", "frances": "fran frankie fanny", "francis": "frank", "frederick": "fred freddie freddy", "gabriel": "gabe", "geoffrey": "geoff", "gerald": "gerry jerry",
    "gilbert": "gil bert", "gregory": "greg", "gwendolyn": "gwen wendy", "harold": "harry hal", "henrietta": "hetty etta hettie", "henry": "hank harry", "herbert": "herb bert", "isaac": "ike zac", "isabella": "bella isa izzy",
    "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie",
    "judith": "judy", "katherine": "kathy kitty kate katie", "kenneth": "ken kenny", "kimberly": "kim kimmy", "lawrence": "larry lars lawrie", "leonard": "len lenny", "lucille": "lucy lu lucie", "margaret": "maggie meg peggy marge greta",
    "matthew": "matt matty", "michael": "mike mick", "nathaniel": "nat nate nathan", "nicholas": "nick", "nicolette": "nicky nikki colette", "norman": "norm", "oliver": "ollie olly", "olympia": "pia lymp", "pamela": "pam",
    "patricia": "pat patty trish tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "quentin": "quin quinn", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick richie", "robert": "bob rob bobby robbie bert",
    "ronald": "ron ronnie", "samantha": "sam", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sally sadie", "stephen": "steve", "steven": "steve", "susan": "sue susie", "susannah": "sue susie suzy susan",
    "terence": "terry", "teresa": "terry tess", "theodora": "dora thea theo", "theodore": "teddy ted theo", "thomas": "tom tommy", "timothy": "tim", "ursula": "ulla uschi sula", "valerie": "val",
    "victoria": "vicky tori vic vickie", "vincent": "vince vinny vin", "virginia": "ginny", "walter": "walt", "william": "bill will billy willie", "winifred": "winnie fred freda", "yolanda": "yoli yola landa", "zachary": "zach zack zak",
}
TITLES = {"dr", "prof", "professor", "rev", "hon", "capt", "captain", "mr", "mrs", "ms", "miss", "sir", "col", "lt", "sgt", "maj", "gen"}
DEGREES = {"phd", "md", "edd", "mpa", "mba", "ma", "ms", "msc", "ba", "bsc", "jd", "esq", "esquire", "cpa", "rn", "dphil", "llm", "pe", "mph", "mls"}
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}
# Small words that belong to the surname after them.
PARTICLES = {"af", "al", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "zu"}
# Kinds of bodies and frequent words of their names, with abbreviations.
BODIES = {
    "agency": "agcy", "archive": "arch archives", "association": "assn assoc", "authority": "auth", "board": "bd brd", "bureau": "bur", "centre": "center ctr cntr", "college": "coll", "commission": "commn comm",
    "committee": "cttee cmte", "council": "cncl", "department": "dept", "directorate": "dir", "division": "div", "foundation": "fdn found", "institute": "inst", "laboratory": "lab",
    "library": "lib", "ministry": "min", "museum": "mus", "office": "off ofc", "registry": "reg", "school": "sch", "service": "svc", "society": "soc", "trust": "tr", "union": "un", "university": "univ",
    "company": "co", "corporation": "corp",
}
WORDS = {
    "administration": "admin", "affairs": "aff", "development": "dev devt devel", "economics": "econ", "education": "educ ed", "engineering": "engrg eng engg engng", "environment": "env environ", "forestry": "for",
    "history": "hist", "housing": "hsg", "information": "info", "international": "intl", "management": "mgmt mgt mgmnt", "maintenance": "maint", "national": "natl", "operations": "ops", "planning": "plng plan", "policy": "pol",
    "protection": "prot", "records": "recs rec", "regulation": "regn", "relations": "rels", "research": "res rsch", "resources": "rsrcs", "safety": "saf", "science": "sci", "security": "sec", "services": "svcs serv svc",
    "standards": "stds std", "statistics": "stat stats", "studies": "stud", "surveys": "surv survs", "technology": "tech", "training": "trng trg", "transport": "transp",
}
# Legal forms, with their writings; those of two letters may also be initials.
LEGAL = {
    "incorporated": "inc", "limited": "ltd", "corporation": "corp", "company": "co", "llc": "", "llp": "", "plc": "", "gmbh": "", "ag": "", "kg": "", "sa": "", "sarl": "", "srl": "", "spa": "", "bv": "", "nv": "", "oy": "", "ab": "", "pty": "",
}


def table(names: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Every short form with all the full names it may stand for."""
    out: dict[str, list[str]] = {}
    for full, shorts in names.items():
        for short in shorts.split():
            out.setdefault(short, []).append(full)
    return {short: tuple(fulls) for short, fulls in out.items()}


_FULLS = table(NICKNAMES)
_BODY = {w: full for full, shorts in BODIES.items() for w in (full, *shorts.split())}
_LAST_BODY = {w: full for w, full in _BODY.items() if w == full or len(w) > 3}
_WORD = {w: full for full, shorts in WORDS.items() for w in shorts.split()}
_LEGAL = {w: full for full, shorts in LEGAL.items() for w in (full, *shorts.split())}
_SMALL = {"of", "on", "for", "the", "and", "in"}
_SPACES = re.compile(r"[\s 　​﻿]+")
_HYPHENS = re.compile(r"\s*[-‐‑‒–—−]\s*")
_NOTE = re.compile(r"\s*[\[(][^\])]*[\])]\s*$")
_SEP = "\x1f"


def folded(text: str) -> str:
    """Lower case without marks on letters, hyphens as '-', runs of space as one."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and (c.isprintable() or c.isspace()))
    text = text.replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("’", "'")
    return _HYPHENS.sub("-", _SPACES.sub(" ", text)).strip().lower()


def seen(word: str) -> str:
    """What the eye may take a word for: letter groups that are mistaken for one another are made equal. Only a misread form, never a key."""
    for group, letter in (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("1", "l"), ("0", "o")):
        word = word.replace(group, letter)
    return word


def slips(word: str) -> set[str]:
    """The word and all words that lack one of its letters: two words within one slip (a letter lost, added, changed, or two swapped) share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def misread(word: str) -> set[str]:
    """What a word shares with those that are one slip, one mistaken letter group, or both away from it."""
    return slips(word) | slips(seen(word))


def _near() -> dict[str, str]:
    """Given names one slip away, by what they share, where that tells which name it was."""
    made: dict[str, set[str]] = {}
    for full in NICKNAMES:
        for x in misread(full):
            made.setdefault(x, set()).add(full)
    return {x: next(iter(names)) for x, names in made.items() if len(names) == 1}


_NEAR = _near()


def mended(word: str) -> str | None:
    """The single known given name that a word is one slip from, if it is none itself."""
    if word in NICKNAMES or word in _FULLS or len(word) < 2:
        return None
    near = {_NEAR[x] for x in misread(word) if x in _NEAR}
    return near.pop() if len(near) == 1 else None


def given_name(word: str) -> str:
    """The full name of a short form that has only one; any other word is itself."""
    fulls = _FULLS.get(word, ())
    return fulls[0] if len(fulls) == 1 and word not in NICKNAMES else word


def _known(word: str) -> bool:
    return word in NICKNAMES or word in _FULLS or mended(word) is not None


def _initial(word: str) -> bool:
    return len(word.rstrip(".")) == 1


def _clean(word: str) -> str:
    return re.sub(r"[^\w]", "", word)


def _joined(words: list[str]) -> list[str]:
    """Particles made one word with what follows them; the first word of a name is none."""
    out: list[str] = []
    held = ""
    for i, w in enumerate(words):
        if i and w in PARTICLES and i + 1 < len(words):
            held += w
        else:
            out.append(held + w)
            held = ""
    return out


def parse(name: str) -> dict:
    """kind 'person', 'body' or 'several' with the parts of the name; empty parts are ''.

    A person has surname, given (full, short with several full names, or one letter),
    middle (words or letters, one space between), generation, and `split`, the surname
    by its words where it has more than one. A body has place, body and subject, or
    place and letters (initials), or place and legal form as body.
    """
    text = folded(name)
    several = {"kind": "several"}
    if not any(c.isalpha() for c in text):
        return several
    if body := _legal(name, text) or _body(name, text):
        return body
    if ";" in text or " and " in text or " & " in text or "/" in text:
        return several
    while (cut := _NOTE.sub("", text)) != text:
        text = cut
    # Two capitals in a name that is not all capitals are initials, not a word.
    if name != name.upper():
        for pair in re.findall(r"\b[A-Z]{2}\b", name):
            if name.startswith(pair) or not re.search(rf",\s*{pair}\s*$", name) and pair.lower() not in GENERATIONS:
                text = re.sub(rf"\b{pair.lower()}\b", f"{pair[0].lower()}. {pair[1].lower()}.", text, count=1)
    pieces = [p.strip() for p in text.split(",")]
    generation, kept = "", []
    for i, p in enumerate(pieces):
        plain = p.replace(".", "").replace(" ", "")
        dotted = re.fullmatch(r"[a-z]\.\s?[a-z]\.?", p) and len(pieces) == 2 and " " not in pieces[0]
        if dotted:
            kept.append(p)  # a surname and initials, even if they spell something
        elif i and plain in GENERATIONS:
            generation = GENERATIONS[plain]
        elif not (i and plain in DEGREES) and p:
            kept.append(p)
    apart = lambda p: re.sub(r"\.(?=[^\s.])", ". ", p).split()
    parts = [apart(p) for p in kept]
    if not parts or len(parts) > 2:
        return several  # a list of names
    rest = parts[-1]
    if len(parts) == 1:
        while len(rest) > 1 and rest[0].rstrip(".") in TITLES:
            rest = rest[1:]
    while len(rest) > 1 and rest[-1].replace(".", "") in GENERATIONS:
        generation, rest = GENERATIONS[rest[-1].replace(".", "")], rest[:-1]
    rest = [w for w in rest if w.rstrip(".") not in TITLES] or rest
    split: list[str] = []
    if len(parts) == 2:
        last = parts[0]
        if len(last) > 1 and len(rest) > 1 and _known(last[0]) and _known(rest[0]) and not _initial(rest[-1]):
            return several  # two names, each given name first
        while len(rest) > 1 and rest[-1] in PARTICLES:
            last, rest = [rest[-1], *last], rest[:-1]
        given, middles, surname = rest[0], rest[1:], "".join(last)
        split = [] if any(w in PARTICLES for w in last) else last
    else:
        rest = _joined(rest)
        if len(rest) < 2:
            return {"kind": "person", "surname": _clean(rest[0]), "given": "", "middle": "", "generation": generation, "split": []}
        full = [i for i, w in enumerate(rest) if not _initial(w)]
        # A known given name after a word that is none begins a second person.
        second = [i for i in full if i >= 2 and _known(rest[i]) and not _initial(rest[i - 1]) and not _known(rest[i - 1]) and (i + 1 < len(rest) or _known(rest[0]))]
        if not full or second:
            return several
        if _initial(rest[-1]):
            # Surname Given M: the surname comes first.
            if full != [0, 1]:
                return several
            surname, given, middles = rest[0], rest[1], rest[2:]
        else:
            if any(_initial(rest[i]) for i in range(full[1] if len(full) > 1 and full[0] == 0 else full[0] + 1, len(rest))):
                return several  # initials after the surname: a second name
            if full[0] > 0 and len(full) == 2 and not _known(rest[full[0]]):
                surname, given, middles = "".join(rest[full[0] :]), rest[0], rest[1 : full[0]]
                split = rest[full[0] :]
            else:
                surname, given, middles = rest[-1], rest[0], rest[1:-1]
    split = [_clean(x) for w in split or [surname] for x in w.split("-") if _clean(x)]
    return {"kind": "person", "surname": _clean(surname), "given": given_name(_clean(given)), "middle": " ".join(filter(None, map(_clean, middles))), "generation": generation, "split": split if len(split) > 1 else []}


def _legal(name: str, text: str) -> dict | None:
    """A name that ends in a legal form."""
    words = [w for w in re.split(r"[\s,]+", _NOTE.sub("", text)) if w]
    form = _LEGAL.get(words[-1].replace(".", "")) if len(words) > 1 else None
    if not form or (len(words[-1].replace(".", "")) == 2 and len(words) == 2 and form != "company") or any(w in _BODY and w not in _LEGAL for w in words[:-1]) and any(w in _SMALL for w in words):
        return None
    stem = [re.sub(r"[^\w]", "", w) for w in words[:-1] if w not in ("&", "and", "the")]
    stem = [_WORD.get(w, w) for w in stem if w]
    return {"kind": "body", "place": "".join(stem), "body": form, "subject": "", "letters": "", "stem": stem} if stem else None


def _body(name: str, text: str) -> dict | None:
    """The parts of an organisation's name, or None if it is none."""
    text = re.sub(r"^the ", "", text)
    note = re.search(r"\(([^)]*)\)\s*$", text)
    plain = text[: note.start()].strip() if note else text
    words = [w for w in re.split(r"[\s,.]+", plain) if w]
    bodies = [i for i, w in enumerate(words) if w in _BODY]
    linked = [i for i in bodies if i + 1 < len(words) and words[i + 1] in _SMALL or i == len(words) - 1]
    full = lambda ws: " ".join(_WORD.get(w, w) for w in ws if w not in _SMALL)
    if not bodies or not any(w in _SMALL for w in words):
        if len(words) > 1 and words[-1] in _LAST_BODY and "," not in plain and "." not in plain[:-1] and ";" not in plain:
            return {"kind": "body", "place": full(words[:-1]).replace(" ", ""), "body": _LAST_BODY[words[-1]], "subject": "", "letters": ""}
        last = name.split()[-1:] or [""]
        letters = last[0].strip("().")
        if len(words) == 2 and 2 <= len(letters) <= 5 and letters.isupper() and not name.split()[0].isupper():
            return {"kind": "body", "place": words[0], "body": "", "subject": "", "letters": letters.lower()}
        return None
    at = (linked or bodies)[0]
    body = _BODY[words[at]]
    parts = [p.strip() for p in plain.split(",")]
    split = lambda p: [w for w in re.split(r"[\s.]+", p) if w]
    if len(parts) == 2:
        head, tail = split(parts[0]), split(parts[1])
        if head and head[0] in _BODY:  # Body of Subject, Place
            subject, place = head[1:], tail
        else:  # Subject, Body of (Place)
            subject, place = head, split(note.group(1)) if note else []
    else:
        place, subject = words[:at], words[at + 1 :]
        if not place and note:
            place = split(note.group(1))
    subject = full(subject)
    if not place:  # Body of Place
        return {"kind": "body", "place": subject.replace(" ", ""), "body": body, "subject": "", "letters": ""}
    letters = "".join(w[0] for w in (body, *subject.split()))
    return {"kind": "body", "place": "".join(place), "body": body, "subject": subject, "letters": letters}


def _ordered(a: str, b: str, c: str) -> tuple[str, str]:
    """Surname and given name; of two words alone, the one that is a known full given name is the given name, wherever it stands."""
    return (b, a) if not c and a in NICKNAMES and b not in NICKNAMES and b not in _FULLS and len(b) > 1 else (a, b)


def key_of(name: str) -> tuple[str | None, str]:
    """The canonical key of a name (null if it stands for several or none) and its generation."""
    p = parse(name)
    if p["kind"] == "several":
        return None, ""
    if p["kind"] == "person":
        if not p["given"] or not p["surname"]:
            return None, ""
        a, b = _ordered(p["surname"], p["given"], p["middle"])
        return _SEP.join(("p", a, b, p["middle"], " ".join(p["split"]) if a == p["surname"] else "")), p["generation"]
    if not p["place"]:
        return None, ""
    what = f"{p['body']} {p['subject']}".strip()
    return _SEP.join(("b", p["place"], what, p["letters"], " ".join(p.get("stem", ())))), ""


def cut_down(key: str) -> list[str]:
    """The other canonical keys that the bearer of a key may be written by: given name as its initial or a short form, with fewer middle names or their initials, a double surname read as middle name and surname, the given name last; an organisation's place and initials, its name without the legal form, and its words in one run."""
    kind, a, b, c, e = key.split(_SEP)
    out = set()
    if kind == "p":
        middles = c.split()
        shorter = {""} | {" ".join(ws[:i]) for ws in (middles, [m[0] for m in middles]) for i in range(1, len(middles) + 1)}
        words = e.split()
        for g in {b, b[0], *map(given_name, NICKNAMES.get(b, "").split())}:
            for m in shorter:
                x, y = _ordered(a, g, m)
                out.add(_SEP.join(("p", x, y, m, "")))
                out.add(_SEP.join(("p", x, y, m, e)))
            if words:
                out.add(_SEP.join(("p", words[-1], g, " ".join([*middles, *words[:-1]]), "")))
    else:
        if c:
            out.add(_SEP.join(("b", a, "", c, "")))
        if " " in b:
            what, subject = b.split(" ", 1)
            out.add(_SEP.join(("b", a + subject.replace(" ", ""), what, "", "")))
        stem = e.split()
        if stem:
            out.add(_SEP.join(("b", a, b, "", "")))
        if len(stem) == 2:
            x, y = _ordered(stem[1], given_name(stem[0]), "")
            out.add(_SEP.join(("p", x, y, "", "")))
    out.discard(key)
    return sorted(out)


def misread_forms(key: str) -> list[str]:
    """What a key shares with keys that differ from it in one misread word.

    A given name may besides stand for the known one it is a slip of, or for any full
    name of a short form; without middle names a given name that is a slip of a known
    one may stand first.
    """
    kind, a, b, c, _ = key.split(_SEP)
    out = set()
    if kind == "p":
        orders = [(a, b)] + ([(b, a)] if not c and mended(a) and not _known(b) and len(b) > 1 else [])
        for s, g in orders:
            near = mended(g)
            for other in {g, *_FULLS.get(g, ()), *([near] if near else [])}:
                out |= {_SEP.join((kind, "a", x, other, c)) for x in misread(s)}
            if len(g) > 1:
                out |= {_SEP.join((kind, "b", s, x, c)) for x in misread(g)}
    else:
        out |= {_SEP.join((kind, "a", x, b, c if not b else "")) for x in misread(a)}
        if b:
            out |= {_SEP.join((kind, "b", a, x, "")) for x in misread(b)}
    return sorted(out)
