"""SQL for the queries of lexicon_queries, for comparison by another engine."""

from __future__ import annotations

from . import oracle_values as V

_FIELDS = {name: (int(low), int(bits)) for name, low, bits in (f.split(":") for f in V.FIELDS.split())}
_AFTER = dict(zip(*V.LOWER)) | dict(zip(*V.REMOVE_ACCENT))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _named(column: str) -> str:
    return f'"{column}"'


def _swap(column: str, letters: tuple[str, str]) -> str:
    return f"translate({column}, {_quoted(letters[0])}, {_quoted(letters[1])})"


def _in(column: str, values) -> str:
    return f"{column} in ({', '.join(_quoted(v) for v in values)})"


def _map(column: str, table: dict) -> str:
    text = lambda v: str(v) if isinstance(v, int) else _quoted(v)
    return "case " + column + " " + " ".join(f"when {text(k)} then {text(v)}" for k, v in table.items()) + " end"


def _accented(w: str) -> str:
    # Pieces end with a separator; in each the first accented small letter keeps its accent.
    first = "".join(c for c in V.REMOVE_ACCENT[0] if c not in V.LOWER[0])
    before = f"regexp_extract(p, '^[^{first}]*')"
    piece = f"{_swap(before, V.LOWER)} || {_swap(f'p[length({before}) + 1]', V.FIX_GRAVE)} || {_swap(f'coalesce(p[length({before}) + 2:], {chr(39)}{chr(39)})', ("".join(_AFTER), "".join(_AFTER.values())))}"
    whole = f"array_to_string(list_transform(regexp_extract_all({w}, '[^ \\t]+[ \\t]?|[ \\t]'), lambda p: {piece}), '')"
    return f"case when regexp_matches({w}, '[σΣς]$') then left({whole}, length({whole}) - 1) || 'ς' else {whole} end"


_UNACCENTED, _SORT = _swap("word", V.UNACCENT), _swap("word", V.COLLATE)
_WORDS = "words as (select distinct word from forms where word is not null and word <> '')"
_SPLIT = r"regexp_split_to_array({0}, '[ \t\r\n()\[\],.\-;:{{}}?!/\\&%+=]+')"
_STOP = _in("lower({0})", V.STOPWORDS.split())
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _transliterated(w: str, marked: bool) -> str:
    table = dict(zip(*V.LATIN)) | {pair[0]: pair[1:] for pair in V.LATIN_TWO.split()} | (dict(zip(*V.LATIN_LONG)) if marked else {})
    cells = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in table.items()) + "}"
    return f"array_to_string(list_transform(string_split({w}, ''), lambda c: coalesce(({cells})[c], '')), '')"


def _keyed(source: str, extra: str) -> str:
    """CTEs that end in posting(extra columns, tier, keyword) for source (word, extra columns)."""
    return f"""keyed as (select {extra}, word, {_accented("word")} as a, {_UNACCENTED} as u from {source} where strlen(word) between 1 and 499),
prefix as (select {extra}, a, u, unnest(range(2, least(length(a) - 1, 49) + 1)) as k from keyed),
posting as (
  select {extra}, 1 as tier, a as keyword from keyed
  union all select {extra}, 2, u from keyed where a <> u
  union all select {extra}, 3, left(a, k) from prefix where not {_STOP.format("left(a, k)")}
  union all select {extra}, 3, left(u, k) from prefix where left(a, k) <> left(u, k) and not {_STOP.format("left(u, k)")})"""


_LEXICON = f"""kept as (select min(lexeme_no) as lexeme_no from lexemes where word is not null and word <> '' group by word),
lex as (select l.* from lexemes l join kept using (lexeme_no)),
form as (
  select f.*, l.word as lexeme_word, l.glosses as lexeme_glosses, coalesce(len(f.refs), 0) as n_refs, coalesce(len(f.glosses), 0) as n_glosses,
    coalesce(f.preferred, false) as pref, {_swap("f.word", V.COLLATE)} as sort_key
  from forms f join lex l on f.lexeme_no = l.lexeme_no where f.word is not null and f.word <> '')"""
_FORM_COLS = "lexeme_no, form_no, uid, n_refs, n_glosses, pref, lexeme_word, sort_key, form_word"
_FORM_RANK = """row_number() over (partition by keyword, tier order by strlen(form_word), case when tier <> 3 then coalesce(lexeme_word = keyword, false) end desc nulls last,
  n_refs desc, case when n_refs = 0 then n_glosses end desc nulls last, case when n_refs = 0 and n_glosses = 0 then pref end desc nulls last,
  case when n_refs = 0 and n_glosses = 0 then sort_key end asc nulls first, case when n_refs = 0 and n_glosses = 0 then form_word end asc nulls first,
  uid asc nulls last, lexeme_no, form_no)"""
_TOKENS = f"""first as (select lexeme_no, min(form_no) as first_no from form group by lexeme_no),
marked as (select f.*, first_no from form f join first using (lexeme_no)),
entry1 as (
  select lexeme_no, form_no, unnest(coalesce(list_filter(glosses, lambda g: g.lang = 'en')[1].entries, list_filter(lexeme_glosses, lambda g: g.lang = 'en')[1].entries)) as entry
  from marked where form_no = first_no),
token1 as (
  select lexeme_no, form_no, {_ASCII_LOWER.format("t")} as token from (select *, unnest({_SPLIT.format("entry")}) as t from entry1)
  where t <> '' and (strlen(t) = strlen(entry) or not {_STOP.format("t")})),
entry2 as (
  select lexeme_no, form_no, i, unnest(es) as entry, generate_subscripts(es, 1) as e from (
    select lexeme_no, form_no, 0 as i, flatten(list_transform(list_filter(glosses, lambda g: g.lang = 'en'), lambda g: g.entries)) as es from marked where form_no <> first_no)),
token2 as (
  select lexeme_no, t as token, min(form_no) as form_no from (select *, unnest({_SPLIT.format("entry")}) as t from entry2)
  where t <> '' and (strlen(t) = strlen(entry) or not {_STOP.format("t")}) group by lexeme_no, t),
gloss_token as (
  select lexeme_no, form_no, token from token1
  union all select lexeme_no, form_no, token from token2 t where not exists (select 1 from token1 p where p.lexeme_no = t.lexeme_no and p.token = t.token))"""


def _bits(name: str, column: str = "packed") -> str:
    low, bits = _FIELDS[name]
    return f"(({column} >> {low}) & {(1 << bits) - 1})"


def _positional(notation: str) -> str:
    """Tags written in a notation with what they have to be read as; wrong ones with their error."""
    names, gap, order, end = {
        "cntr": ("2:V 3:N 4:A 10:E 5:D 6:C 8:P 11:I 1:X", "       ", "mood tense voice person case gender number", ""),
        "morphgnt": ("2:V- 3:N- 4:A- 10:RA 15:RR 16:RD 5:D- 6:C- 8:P- 11:I- 1:X-", " ", "person tense voice mood case number gender", "-"),
        "ccat": ("2:VX 3:N_ 4:A_ 10:RA 15:RR 16:RD 5:D 6:C 8:P 11:I 1:X", "  ", "", ""),
    }[notation]
    table = {int(k): v.replace("_", " ") for k, v in (x.split(":") for x in names.split())}
    pick = lambda letters, n: f"'{letters}'[{_bits(n)} + 1]"
    parts = {"mood": pick(".ISOMNP", "mood"), "tense": pick(".PFAIEL", "tense"), "voice": pick(".AMP", "voice"), "person": pick(".123", "person"), "case": pick(".NAGDV", "case"), "gender": pick(".MF.N", "gender"), "number": pick(".S.P", "number")}
    nominal = f"{parts['case']} || {parts['number']} || {parts['gender']}"
    written = " || ".join(parts[n] for n in order.split())
    if notation == "ccat":
        finite = f"{pick(' 123', 'person')} || {pick(' S P', 'number')}"
        written = f"""case when {_bits('pos')} = 2 then {parts['tense']} || {parts['voice']} || {parts['mood']} || case {_bits('mood')} when 6 then {nominal} when 5 then '' else {finite} end
    when {_bits('case')} > 0 then {nominal} else '' end"""
    flags = " and ".join(f"{_bits(n)} = 0" for n in ("crasis", "interrogative", "negative", "correlative", "indefinite", "indeclinable"))
    return f"""with tag as (
  select packed, {_map(_bits("pos"), table)} || '{gap}' as head, {written} as body, {_bits("pos")} as pos, {_bits("case")} as "case" from parsing_tags
  where {flags} and {_bits("number")} <> 2 and {_bits("pos")} in ({", ".join(map(str, table))}) and {_bits("tense")} <= 6 and {_bits("voice")} <= 3 and ({_bits("pos")} = 2 or {_bits("gender")} in (0, 1, 2, 4)))
select distinct head || body || '{end}' as text, packed as "read", null::varchar as error from tag
union select 'Q' || head || body || '{end}', null, 'UnknownPartOfSpeech' from tag
union select head || translate(body, 'NAGDV', 'ZZZZZ') || '{end}', null, 'UnknownCase' from tag where "case" > 0 and pos <> 2"""


_REF = "ref.module || '#' || ref.book || ' ' || ref.chapter || ':' || ref.verse || case when ref.word > 0 then ' ' || ref.word else '' end"
# Packed records of the parsings that a primary form may have, by part of speech and in order.
_WANTED = """(2, 0, 10519074), (2, 1, 10617378), (2, 2, 10551842), (2, 3, 10584610), (2, 4, 10519106), (2, 5, 10519138), (2, 6, 10519170),
  (3, 0, 8654851), (3, 1, 8658947), (3, 2, 8667139), (4, 0, 8654852), (4, 1, 8658948), (4, 2, 8667140)"""
_SLOTS = """
  select 'verb' as kind, panel_no, title, subtitle, side, person - case mood when 4 then 2 else 1 end as slot, 2 as pos, tense, voice, mood, person, number, 0 as "case", 0 as slot_gender
  from (values (1, 'Present', 'Active', 1, 1, 1), (2, 'Future', 'Active', 2, 1, 1), (3, 'Imperfect', 'Active', 4, 1, 1), (4, 'Aorist', 'Active', 3, 1, 1),
    (5, 'Perfect', 'Active', 5, 1, 1), (6, 'Pluperfect', 'Active', 6, 1, 1), (7, 'Subjunctive', 'Present Active', 1, 1, 2), (8, 'Subjunctive', 'Aorist Active', 3, 1, 2),
    (9, 'Subjunctive', 'Present Mid', 1, 2, 2), (10, 'Subjunctive', 'Aorist Mid', 3, 2, 2), (11, 'Subjunctive', 'Present Psv', 1, 3, 2), (12, 'Subjunctive', 'Aorist Psv', 3, 3, 2),
    (14, 'Present', 'Passive', 1, 3, 1), (15, 'Future', 'Middle', 2, 2, 1), (16, 'Future', 'Passive', 2, 3, 1), (17, 'Imperfect', 'Passive', 4, 3, 1), (18, 'Aorist', 'Passive', 3, 3, 1),
    (19, 'Imperative', 'Present Active', 1, 1, 4), (20, 'Imperative', 'Aorist Active', 3, 1, 4), (21, 'Imperative', 'Present Psv', 1, 3, 4), (22, 'Imperative', 'Aorist Psv', 3, 3, 4))
    p(panel_no, title, subtitle, tense, voice, mood), (values ('top', 1), ('bottom', 3)) s(side, number), (values (1), (2), (3)) q(person) where mood <> 4 or person > 1
  union all select 'verb', 13, 'Infinitive', '', side, slot, 2, tense, voice, 5, 0, 0, 0, 0 from (values ('top', 0, 1, 1), ('top', 1, 3, 1), ('bottom', 0, 1, 3), ('bottom', 1, 3, 3)) i(side, slot, tense, voice)
  union all select kind, panel_no, title, '', side, slot, pos, 0, 0, 0, 0, number, "case", gender from (values ('noun', 3), ('adjective', 4)) k(kind, pos),
    (values (1, 'Masculine', 1), (2, 'Feminine', 2), (3, 'Neuter', 4)) g(panel_no, title, gender), (values ('top', 1), ('bottom', 3)) s(side, number), (values (0, 1), (1, 3), (2, 4), (3, 2)) c(slot, "case")
  union all select 'pronoun', panel_no, title, '', 'top', "case" - 1, 13, tense, 0, 0, person, 0, "case", 0
    from (values (1, 'Singular', 11, 1), (2, 'Plural', 12, 1), (3, 'Singular', 11, 2), (4, 'Plural', 12, 2)) n(panel_no, title, tense, person), (values (1), (2), (3), (4)) c("case")"""
_KIND = "case when {0} = 2 then 'verb' when {0} = 3 or {0} = 7 and {1} = 0 then 'noun' when {0} = 13 then 'pronoun' when {0} = 4 then 'adjective' end".format(_bits("pos", "l.pos"), _bits("indeclinable", "l.pos"))
_CELLS = f"""slots as ({_SLOTS}),
part as (
  select f.lexeme_no, f.form_no, f.word, {_KIND} as kind, {", ".join(f"{_bits(n, 'f.parsing')} as f_{n}" for n in ("pos", "tense", "voice", "mood", "person", "number", "case", "gender"))}
  from form f join lex l on f.lexeme_no = l.lexeme_no),
cell as (
  select p.lexeme_no, s.kind, s.panel_no, s.title, s.subtitle, s.side, s.slot, min(p.form_no) as form_no, arg_min(p.word, p.form_no) as word
  from part p join slots s on p.kind = s.kind and p.f_pos = s.pos and case s.kind
    when 'verb' then p.f_tense = s.tense and p.f_mood = s.mood and (s.mood = 5 or p.f_person = s.person and p.f_number = s.number)
      and case s.voice when 1 then p.f_voice = 1 when 2 then p.f_voice in (2, 5, 4, 7) else p.f_voice in (3, 6, 4, 7) end
    when 'pronoun' then p.f_tense = s.tense and p.f_person = s.person and p.f_case = s."case"
    else p.f_case = s."case" and p.f_number = s.number and p.f_gender = s.slot_gender end
  group by all)"""
_POSTINGS = f"select keyword, tier, rank, lexeme_no, form_no from (select *, {_FORM_RANK} as rank from posting) where rank <= 60"
_FORM_SOURCE = f"src as (select word, {_FORM_COLS.replace('form_word', 'word as form_word').replace('pref,', 'pref,')} from form)"
_GLOSS_SOURCE = f"""either_token as (
  select lexeme_no, form_no, token from gloss_token
  union all select lexeme_no, form_no, {_transliterated("word", False)} from form),
src as (select b.token as word, {_FORM_COLS.replace("form_word", "f.word as form_word").replace("lexeme_no, form_no", "f.lexeme_no, f.form_no")} from either_token b join form f on b.lexeme_no = f.lexeme_no and b.form_no = f.form_no where b.token <> '')"""

_MARK = {"/": "chr(769)", "\\": "chr(768)", "(": "chr(788)", ")": "chr(787)", "|": "chr(837)", "+": "chr(776)", "=": "chr(834)"}
# Combinations of marks that are read, in the order of Unicode; letters that come out otherwise than composed.
_SETS = ")/ (/ )\\ (\\ )= (= /| \\| =| )| (| )/| (/| )\\| (\\| )=| (=| +/ +\\ += ) ( / \\ = | +".split()
_ODD = "Υ)ὐ ε)\\ἔ Ω)\\Ὤ Ε(\\Ἒ Ι+\\ῒ Υ+\\ῢ ι+/ΐ Ι+/ΐ Υ+/ΰ Υ)=ὖ η(\\|ᾕ ω(\\|ᾥ Η(\\|ᾝ Ω(\\|ᾭ".split()
_BETACODE = rf"""
with tok as (select distinct unnest(regexp_extract_all(text, '[^ \t\r\n\x0B\f]+')) as t from documents),
cut as (select t, regexp_extract(t, '^[A-Za-z/\\()|+=^123]*') as p from tok),
split as (
  select t, t[length(p) + 1:] as rest, regexp_extract(p, '^[^A-Za-z]*') as lead, regexp_extract_all(p, '[A-Za-z][^A-Za-z]*') as gs from cut),
unit as (
  select t, i, len(gs) as n, {_swap("gs[i][1]", V.BETACODE)} as l, replace(gs[i][2:] || case when i = 1 then lead else '' end, '^', '=') as m
  from (select *, unnest(range(1, len(gs) + 1)) as i from split)),
marked as (
  select *, regexp_extract(m, '[123]') as sign,
    {" || ".join(f"case when contains(m, {_quoted(c)}) then {_quoted(c)} else '' end" for c in ")(+/\\=|")} as marks,
    (contains(m, '1')::int + contains(m, '2')::int + contains(m, '3')::int) as signs from unit),
formed as (
  select *, nfc_normalize(l || {" || ".join(f"case when contains(marks, {_quoted(c)}) then {x} else '' end" for c, x in ((c, _MARK[c]) for c in ")(+\\/=|"))}) as joined,
    case l || marks {" ".join(f"when {_quoted(o[:-1])} then {_quoted(o[-1])}" for o in _ODD)} end as odd from marked),
letter as (
  select t, i, n, case
      when signs = 0 and marks = '' then case when l = 'σ' and i = n then 'ς' else l end
      when signs > 0 then case when signs + length(marks) > 1 or l not in ('σ', 'Σ', 'ς') then null when l = 'Σ' then case sign when '3' then 'Ϲ' else 'Σ' end
        else case sign when '1' then 'σ' when '2' then 'ς' else 'ϲ' end end
      when odd is not null then odd
      when marks in ({", ".join(_quoted(x) for x in _SETS)}) and length(joined) = 1 and joined <> 'ῤ' then joined end as g from formed),
word as (
  select t, string_agg(g, '' order by i) as greek, bool_or(g is null and i < n) as bad_inside, bool_or(g is null) as bad from letter group by t),
whole as (
  select s.t, coalesce(greek, '') || case when rest[1] = '''' then '᾽' else '' end as greek, case when rest[1] = '''' then rest[2:] else rest end as more,
    coalesce(bad_inside, false) as bad_inside, coalesce(bad, false) as bad, rest <> '' and (unicode(rest[1]) > 127 or rest[1] = '*') as stops
  from split s left join word w on s.t = w.t),
read as (
  select t, greek, case when bad_inside then 'UnexpectedAccent' when stops then 'UnexpectedCharacter' when bad then 'UnexpectedAccent' when more <> '' then 'UnexpectedCharacter'
    when strlen(greek) > 500 then 'Overflow' end as error from whole)
"""
_TEXT = "coalesce({0}::varchar, '')"
_GLOSS_TEXT = "coalesce(array_to_string(list_transform({0}, lambda g: g.lang || ':' || array_to_string(g.entries, ':')), '#'), '')"
_LABELS = {i: {14: "PosessivePronoun", 19: "HebrewTransliteration", 25: "", 28: ""}.get(i, label.strip().replace(" ", "")) for i, label in enumerate(V.LABELS.split(","))}
_LINES = f"""tag as (select packed, min(tag) as tag from parsing_tags group by packed),
lines as (
  select concat_ws('|', {_TEXT.format("word")}, {_TEXT.format("lang")}, {_TEXT.format("uid")}, coalesce({_map(_bits("pos", "pos"), _LABELS)}, ''),
    coalesce({_map("article", {0: "", 1: "ὁ", 2: "ἡ", 3: "ὁ ἡ", 4: "τό", 5: "ὁ τό", 7: "ὁ ἡ τό"})}, ''), {_TEXT.format("genitive_suffix")}, coalesce(array_to_string(strongs, ','), ''),
    {_TEXT.format("root")}, {_GLOSS_TEXT.format("glosses")}, {_TEXT.format("adjective")}, coalesce(array_to_string(tags, ', '), ''), {_TEXT.format("note")}) as line from lex
  union all
  select '  ' || concat_ws('|', f.word, coalesce(case when regexp_matches(t.tag, '^P-[12]') then left(t.tag, 4) else t.tag end, ''), case when pref then 'true' else 'false' end, {_TEXT.format("uid")},
    {_GLOSS_TEXT.format("glosses")}, coalesce(array_to_string(list_transform(refs, lambda r: r.module || '#' || r.book || ' ' || r.chapter || ':' || r.verse || case when r.word > 0 then ' ' || r.word else '' end), ','), ''))
  from form f left join tag t on f.parsing = t.packed)"""

SQL = {
    "word_keys": f"""with {_WORDS} select word, {_accented("word")} as accented, {_UNACCENTED} as unaccented, {_swap("word", V.LOWER)} as lowercased,
  {_SORT} as sort_key, {_swap("word", V.NORMALISE)} as normalised from words""",
    "transliterate": f"with {_WORDS} select word, {_transliterated('word', False)} as plain, {_transliterated('word', True)} as marked from words",
    "prefix_keywords": f"with {_WORDS}, {_keyed('words', 'word')} select tier, keyword, count(*) as n from posting group by tier, keyword".replace("select word, word, ", "select word, "),
    "collation_rank": f"with {_WORDS} select word, row_number() over (order by {_SORT}, word) as rank from words",
    "form_collation_rank": f"""select lexeme_no, form_no, row_number() over (order by {_SORT}, word, case when coalesce(preferred, false) then 0 else 1 end,
  -coalesce(len(glosses), 0), lexeme_no, form_no) as rank from forms where word is not null and word <> ''""",
    "part_name_index": f"""with src as (select p_name as word, p_partkey, p_retailprice from part), {_keyed("src", "p_partkey, p_retailprice")}
select keyword, tier, rank, p_partkey from (select *, row_number() over (partition by keyword, tier order by p_retailprice desc, p_partkey) as rank from posting) where rank <= 5""",
    "autocomplete": f"""with {_LEXICON}, {_FORM_SOURCE}, {_keyed("src", _FORM_COLS)},
ask as (select distinct left(word, 3) as word from lex where lexeme_no % 100 = 0),
key as (select {_accented("word")} as a, {_UNACCENTED} as u from ask where strlen(word) between 1 and 499),
known as (select distinct keyword from posting),
hit as (select distinct coalesce(ka.keyword, ku.keyword) as keyword from key left join known ka on a = ka.keyword left join known ku on u = ku.keyword),
found as (select distinct p.* from posting p join hit using (keyword) where tier = 3)
select keyword, rank, lexeme_no, form_no from (select *, {_FORM_RANK} as rank from found) where rank <= 10""",
    "gloss_token_counts": f"""select lang, token, count(*) as n from (
  select lang, entry, unnest({_SPLIT.format("entry")}) as token from (select g.lang, unnest(g.entries) as entry from (select unnest(glosses) as g from lexemes)))
where token <> '' and (strlen(token) = strlen(entry) or not {_STOP.format("token")}) group by lang, token""",
    "stopword_ratio": f"""select lang, count(*) as tokens, sum(case when {_STOP.format("token")} then 1 else 0 end)::bigint as stopwords
from (select lang, unnest({_SPLIT.format("text")}) as token from documents) where token <> '' group by lang""",
    "betacode_words": _BETACODE + "select t as token, case when error is null then greek end as greek, error from read",
    "text_export": f"with {_LEXICON}, {_LINES} select line from lines",
    "postings_top60": f"with {_LEXICON}, {_FORM_SOURCE}, {_keyed('src', _FORM_COLS)} {_POSTINGS}",
    "postings_stored": f"with {_LEXICON}, {_FORM_SOURCE}, {_keyed('src', _FORM_COLS)} {_POSTINGS}",
    "postings_by_uid": f"""with {_LEXICON}, {_FORM_SOURCE}, {_keyed("src", _FORM_COLS)},
best as (select * from (select *, {_FORM_RANK} as rank from posting) where rank <= 60),
owner as (select coalesce(uid, 0) as uid, max((lexeme_no, form_no)) as f from form group by 1)
select keyword, tier, rank, o.f[1] as lexeme_no, o.f[2] as form_no from best b join owner o on coalesce(b.uid, 0) = o.uid""",
    "postings_lexeme_top60": f"""with {_LEXICON}, src as (select word, lexeme_no, {_SORT} as sort_key, word as lexeme_word, coalesce(len(glosses), 0) as n_glosses from lex),
{_keyed("src", "lexeme_no, sort_key, lexeme_word, n_glosses")}
select keyword, tier, rank, lexeme_no from (
  select *, row_number() over (partition by keyword, tier order by sort_key, lexeme_word, n_glosses, lexeme_no) as rank from posting) where rank <= 60""",
    "postings_gloss_top60": f"with {_LEXICON}, {_TOKENS}, {_GLOSS_SOURCE}, {_keyed('src', _FORM_COLS)} {_POSTINGS}",
    "posting_fanout": f"with {_LEXICON}, {_FORM_SOURCE}, {_keyed('src', _FORM_COLS)} select tier, count(*) as postings, count(distinct keyword) as keywords from posting group by tier",
    "gloss_index_tokens": f"with {_LEXICON}, {_TOKENS} select lexeme_no, form_no, token, count(*) as n from gloss_token group by all",
    "lookup_with_fallback": f"""with {_LEXICON}, {_FORM_SOURCE}, {_keyed("src", _FORM_COLS)},
ask as (select lexeme_no as query_no, upper(word) as word from lex where lexeme_no % 100 = 0),
key as (select query_no, {_accented("word")} as a, {_UNACCENTED} as u from ask where strlen(word) between 1 and 499),
known as (select distinct keyword from posting),
hit as (select query_no, coalesce(ka.keyword, ku.keyword) as keyword from key left join known ka on a = ka.keyword left join known ku on u = ku.keyword)
select query_no, p.keyword, tier, count(*) as n, min((lexeme_no, form_no))[1] as lexeme_no, min((lexeme_no, form_no))[2] as form_no
from hit join posting p on hit.keyword = p.keyword group by query_no, p.keyword, tier""",
    "first_wins_dedupe": f"with {_LEXICON} select lexeme_no, word, uid from lex",
    "assign_uids": """select lexeme_no, form_no, case when uid >= 100000 then uid::bigint
  else (select greatest(max(uid), 99999) from forms)::bigint + row_number() over (partition by coalesce(uid >= 100000, false) order by lexeme_no, form_no) end as uid_new from forms""",
    "gloss_fallback": """select f.lexeme_no, f.form_no, array_to_string(coalesce(list_filter(f.glosses, lambda g: g.lang = 'en')[1].entries,
  list_filter(l.glosses, lambda g: g.lang = 'en')[1].entries), '; ') as entries from forms f left join lexemes l on f.lexeme_no = l.lexeme_no""",
    "gloss_string": """select lexeme_no, i, g.lang, array_to_string(g.entries, ', ') || case when len(g.entries) = 0 or g.entries[-1] = '' or right(g.entries[-1], 1) in ('.', ';', ')', ',', '?')
  then '' else '.' end as text from (select lexeme_no, unnest(glosses) as g, (generate_subscripts(glosses, 1) - 1)::int as i from lexemes)""",
    "gloss_text": "select lexeme_no, array_to_string(list_transform(glosses, lambda g: g.lang || ':' || array_to_string(g.entries, ':')), '#') as text from lexemes",
    "has_tag": "select lexeme_no, coalesce(list_contains(list_transform(tags, lambda t: lower(t)), 'food'), false) as food from lexemes",
    "glossed_lexemes": "select lexeme_no from lexemes where len(glosses) > 0",
    # Personal pronouns carry the number of whom they mean in the tense's place.
    "parse_byzantine": r"""select tag, case when regexp_matches(tag, '^P-[12][NAGDV][SP]') then (packed & ~(3 << 23)) | ((case tag[5] when 'S' then 11 else 12 end) << 5)
  else packed end::int as packed, null::varchar as error from parsing_tags""",
    "format_byzantine": r"""select parsing, coalesce(case when regexp_matches(t.tag, '^P-[12]') then left(t.tag, 4) else t.tag end, '') as tag, n
from (select parsing, count(*) as n from forms where parsing is not null group by parsing) f
left join (select packed, min(tag) as tag from parsing_tags group by packed) t on f.parsing = t.packed""",
    "unpack_parsing": "select tag, " + ", ".join(f'{_bits(n)}::int as "{n}"' for n in _FIELDS) + " from parsing_tags",
    "pack_parsing": "select tag, packed, true as same from parsing_tags",
    "parse_cntr": _positional("cntr"),
    "parse_morphgnt": _positional("morphgnt"),
    "parse_ccat": _positional("ccat"),
    "parse_reference": f"select distinct {_REF} as text, ref.module, ref.book, ref.chapter, ref.verse, ref.word from (select unnest(refs) as ref from forms)",
    "concordance": "select ref.module, ref.book, ref.chapter, count(*) as n from (select unnest(refs) as ref from forms) group by all",
    "modules": "select * from (values " + ", ".join(f"({i}, {_quoted(c)}, {_quoted(n)})" for i, (c, n) in enumerate(m.split("/") for m in V.MODULES.split(", "))) + ") t(code, module, name)",
    "books": "select * from (values " + ", ".join(f"({i}, {_quoted(n)}, {_quoted(s)})" for i, (n, s) in enumerate(b.strip().split("/") for b in V.BOOKS.split(", "))) + ") t(code, english, english_short)",
    "articles": f"select {_map('article', {int(k): v for k, v in (g.split(":") for g in V.GENDERS.split(", "))})} as gender, count(*) as n from lexemes group by 1",
    "parts_of_speech": f"select {_map(_bits('pos', 'pos'), dict(enumerate(label.strip() for label in V.LABELS.split(","))))} as label, count(*) as n from lexemes group by 1",
    # Published values of the fingerprint, of texts of 0 to 4, 5, 8, 11, 32 and 256 bytes.
    "farmhash_vectors": """select * from (values ('test', 8581389452482819506), ('3true', -4880158226897771312), ('1footrue', -1541654101129638711), ('2applefalse', 2794438866806483259),
  (repeat('test', 8), -4196240717365766262), (repeat('test', 64), 3500507768004279527)) t(text, hash)""",
    "add_gloss": """select lexeme_no, case when coalesce(len(list_filter(glosses, lambda g: g.lang = 'en')), 0) = 0
    then array_to_string(list_transform(coalesce(glosses, []), lambda g: g.lang || ':' || array_to_string(g.entries, ':')) || ['en:' || coalesce(word, '')], '#')
    else array_to_string(list_transform(range(1, len(glosses) + 1), lambda i: glosses[i].lang || ':' || array_to_string(glosses[i].entries, ':') ||
      case when i = list_position(list_transform(glosses, lambda g: g.lang), 'en') then ':' || coalesce(word, '') else '' end), '#') end as text from lexemes""",
    "primary_form": f"""with {_LEXICON}, wanted(pos, priority, parsing) as (values {_WANTED}),
hit as (
  select f.lexeme_no, f.form_no, f.parsing, f.pref, f.n_glosses > 0 as glossed, f.n_refs, w.priority
  from form f join lex l on f.lexeme_no = l.lexeme_no join wanted w on {_bits("pos", "l.pos")} = w.pos and f.parsing = w.parsing),
start as (select lexeme_no, parsing, min(form_no) as s from hit group by all),
stop as (select f.lexeme_no, s.parsing, min(f.form_no) as e from form f join start s on f.lexeme_no = s.lexeme_no and f.form_no > s.s and f.parsing is distinct from s.parsing group by all),
run as (select h.* from hit h left join stop x on h.lexeme_no = x.lexeme_no and h.parsing = x.parsing where x.e is null or h.form_no < x.e),
base as (select *, coalesce(max(case when pref then form_no end) over w, min(form_no) over w) as b from run window w as (partition by lexeme_no, parsing)),
fit as (select *, row_number() over (partition by lexeme_no, parsing order by glossed desc, n_refs, form_no) as r from base where form_no >= b),
found as (select lexeme_no, arg_min(form_no, priority) as form_no from fit where r = 1 group by lexeme_no)
select f.lexeme_no, coalesce(any_value(x.form_no), min(f.form_no)) as form_no from form f left join found x on f.lexeme_no = x.lexeme_no group by f.lexeme_no""",
    "panel_cells": f"with {_LEXICON}, {_CELLS} select lexeme_no, kind, panel_no, side, slot, form_no, word from cell",
    "panel_tables": f"""with {_LEXICON}, {_CELLS}
select lexeme_no, kind, panel_no, title, subtitle, """
    + ", ".join(f"""array_to_string([{", ".join(f"coalesce(max(case when side = '{s}' and slot = {i} then word end), '-')" for i in range(4))}], ',') as "{s}" """ for s in ("top", "bottom"))
    + "from cell group by all",
}
