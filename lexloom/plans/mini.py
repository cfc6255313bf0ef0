"""A small dictionary of our own for queries and tests: frequent words of the driver's documents, a few productive affixes.

The same literals make the rule file, the lexicon and the VALUES lists of the SQL twins.
"""

from __future__ import annotations

from lexloom.plans.dictionary import Dictionary

#: kind, flag, cross, strip, append, condition, morphology
RULES = [
    ("P", "A", True, "", "re", ".", "dp:again"),
    ("P", "U", True, "", "un", "[^u]", ""),
    ("S", "S", True, "", "s", "[^s]", "is:plur"),
    ("S", "S", True, "", "es", "s", "is:plur"),
    ("S", "D", True, "", "d", "e", "is:past"),
    ("S", "D", True, "", "ed", "[^e]", "is:past"),
    ("S", "G", True, "e", "ing", "e", "is:prog"),
    ("S", "G", True, "", "ing", "[^e]", "is:prog"),
    ("S", "L", False, "", "ly", ".", ""),
]
#: word, flags, morphology
WORDS = [
    *((w, "", "") for w in "of and to is it was be as by are at le la de les des et un une der und die das el los las que del por no".split()),
    *((w, "Y", "") for w in "the that for with this from tion ing ent ment est ble ver lich cion ado".split()),
    *((w, "SD", "po:noun") for w in "er re st th nt in on an en ou ha he her hat".split()),
    *((w, "SDGLY", "") for w in "ther ator onan enth estion ering ation thing andor".split()),
    *((w, "ASDG", "po:verb") for w in "one ate ease use are move make line".split()),
    *((w, "USL", "po:adj") for w in "able even ear eating other inter".split()),
    ("ice", "S", "po:noun"), ("ice", "D", "po:verb"), ("Paris", "S", ""), ("Eau", "S", "po:noun"),
]
REPLACEMENTS = [("th", "t"), ("f", "ph"), ("er", "re")]
TRY = "etaonirsh"
FLAGS = "AUSDGLY"
ALLOWED, FORBIDDEN = ["sawyer", "thatio", "Ouan", "hethe"], ["thes", "ones"]


def files() -> tuple[str, str]:
    """The rule file and the lexicon."""
    aff = ["SET UTF-8", f"TRY {TRY}", f"REP {len(REPLACEMENTS)}", *(f"REP {a} {b}" for a, b in REPLACEMENTS)]
    for kind, flag in dict.fromkeys((r[0], r[1]) for r in RULES):
        own = [r for r in RULES if r[:2] == (kind, flag)]
        aff.append(f"{kind}FX {flag} {'Y' if own[0][2] else 'N'} {len(own)}")
        aff += [f"{kind}FX {flag} {r[3] or 0} {r[4] or 0} {r[5]} {r[6]}".rstrip() for r in own]
    dic = [str(len(WORDS)), *(w + (f"/{f}" if f else "") + (f"\t{m}" if m else "") for w, f, m in WORDS)]
    return "\n".join(aff) + "\n", "\n".join(dic) + "\n"


def dictionary() -> Dictionary:
    return Dictionary.parse(*files())


def _value(x) -> str:
    return "true" if x is True else "false" if x is False else "'" + str(x).replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


def _regex(kind: str, cond: str) -> str:
    return "" if cond == "." else ("^" + cond if kind == "P" else cond + "$")


#: Tables lexicon, rules and forms (stem, form, path: 0 listed, 1 prefix, 2 both, 3 suffix), for a WITH clause.
SQL_FORMS = f"""
lexicon(word, flags, morph, no) AS (SELECT * FROM (VALUES {", ".join(f"({_value(w)}, {_value(f)}, {_value(m)}, {k})" for k, (w, f, m) in enumerate(WORDS))})),
rules(kind, flag, cross_, strip, app, cond, morph) AS (SELECT * FROM (VALUES {_rows((k, f, c, s, a, _regex(k, x), m) for k, f, c, s, a, x, m in RULES)})),
suffixed AS (
  SELECT l.word AS stem, l.flags, l.no, l.morph AS data, r.cross_, r.flag AS sflag, r.morph AS smorph, left(l.word, length(l.word) - length(r.strip)) || r.app AS form
  FROM lexicon l JOIN rules r ON r.kind = 'S' AND contains(l.flags, r.flag) AND length(l.word) > length(r.strip) AND ends_with(l.word, r.strip) AND regexp_matches(l.word, r.cond)),
forms AS (
  SELECT word AS stem, word AS form, 0 AS path, no, morph AS data, '' AS pflag, '' AS pmorph, '' AS sflag, '' AS smorph FROM lexicon
  UNION ALL SELECT stem, form, 3, no, data, '', '', sflag, smorph FROM suffixed
  UNION ALL SELECT l.word, r.app || substr(l.word, length(r.strip) + 1), 1, l.no, l.morph, r.flag, r.morph, '', ''
    FROM lexicon l JOIN rules r ON r.kind = 'P' AND contains(l.flags, r.flag) AND length(l.word) > length(r.strip) AND starts_with(l.word, r.strip) AND regexp_matches(l.word, r.cond)
  UNION ALL SELECT s.stem, r.app || substr(s.form, length(r.strip) + 1), 2, s.no, s.data, r.flag, r.morph, s.sflag, s.smorph
    FROM suffixed s JOIN rules r ON r.kind = 'P' AND r.cross_ AND s.cross_ AND contains(s.flags, r.flag) AND length(s.form) > length(r.strip) AND starts_with(s.form, r.strip) AND regexp_matches(s.form, r.cond))
"""
WORD_RX = r"[\p{L}\p{M}]+"
_UPPER = "[A-ZÀ-ÖØ-ÞŒŸ]"
SQL_KIND = f"""CASE WHEN NOT regexp_matches(word, '{_UPPER}') THEN 'none'
  WHEN regexp_matches(word, '^{_UPPER}') AND NOT regexp_matches(substr(word, 2), '{_UPPER}') THEN 'init'
  WHEN regexp_full_match(word, '({_UPPER}|ß)+') THEN 'all' WHEN regexp_matches(word, '^{_UPPER}') THEN 'mixed_init' ELSE 'mixed' END"""


def sql_tokens(table: str, key: str) -> str:
    return f"tokens AS (SELECT {key}, unnest(regexp_extract_all(text, '{WORD_RX}')) AS word FROM {table})"


#: Verdicts on the distinct words of `tokens`.
SQL_VERDICT = f"""
words AS (SELECT word, {SQL_KIND} AS kind FROM (SELECT DISTINCT word FROM tokens)),
known AS (SELECT DISTINCT form FROM forms),
probes AS (
  SELECT word, word AS form FROM words
  UNION SELECT word, lower(word) FROM words WHERE kind IN ('init', 'all')
  UNION SELECT word, upper(left(lower(word), 1)) || substr(lower(word), 2) FROM words WHERE kind = 'all'
  UNION SELECT word, lower(left(word, 1)) || substr(word, 2) FROM words WHERE kind = 'mixed_init'),
verdict AS (SELECT w.word, w.kind, EXISTS (SELECT 1 FROM probes p JOIN known k ON k.form = p.form WHERE p.word = w.word) AS correct FROM words w)
"""
