"""Python 3.13: grammar and token stream."""

from __future__ import annotations

import re
import unicodedata

GRAMMAR = """
file : stmt* ;
stmt : simple_line | compound ;
simple_line : simples NEWLINE | simples semi NEWLINE ;
simples : simple | simples semi simple ;
block : NEWLINE INDENT stmt+ DEDENT | simple_line ;
simple : star_exprs | assignment | return star_exprs? | pass | break | continue | del targets | yield_expr
 | assert expr | assert expr , expr | raise | raise expr | raise expr from expr | global names | nonlocal names
 | import dotted_as | from from_where import from_what | type name tparams? EQ expr ;
names : name | names , name ;
assignment : chain rhs | single colon expr | single colon expr EQ rhs | single AUG rhs ;
chain : targets EQ | chain targets EQ ;
single : name | primary . name | primary [ slices ] | ( single ) ;
rhs : star_exprs | yield_expr ;
yield_expr : yield star_exprs? | yield from expr ;
dotted : name | dotted . name ;
dotted_as : dotted_as1 | dotted_as , dotted_as1 ;
dotted_as1 : dotted | dotted as name ;
from_where : dots? dotted | dots ;
dots : dot1 | dots dot1 ;
dot1 : . | DOTS ;
from_what : STAR | as_names | ( as_names ) | ( as_names , ) ;
as_names : as_name | as_names , as_name ;
as_name : name | name as name ;

targets : target_list | target_list , ;
target_list : star_target | target_list , star_target ;
star_target : target | STAR target ;
target : name | primary . name | primary [ slices ] | ( ) | [ ] | ( targets ) | [ targets ] ;

compound : if_stmt | while named colon block else_part? | for_stmt | async for_stmt | with_stmt | async with_stmt
 | try_stmt | decorators? definition | match_stmt ;
if_stmt : if named colon block elif_part* else_part? ;
elif_part : elif named colon block ;
else_part : else colon block ;
for_stmt : for targets in star_exprs colon block else_part? ;
with_stmt : with with_items colon block | with ( with_items ) colon block | with ( with_items , ) colon block ;
with_items : with_item | with_items , with_item ;
with_item : expr | expr as star_target ;
try_stmt : try colon block except_part+ else_part? finally_part? | try colon block except_star+ else_part? finally_part? | try colon block finally_part ;
except_part : except colon block | except expr colon block | except expr as name colon block ;
except_star : except STAR expr colon block | except STAR expr as name colon block ;
finally_part : finally colon block ;
decorators : decorator | decorators decorator ;
decorator : AT named NEWLINE ;
definition : class_def | func_def | async func_def ;
class_def : class name tparams? class_args? colon block ;
class_args : ( args? ) ;
func_def : def name tparams? ( params? ) returns? colon block ;
returns : ARROW expr ;
tparams : [ tparam_list ] | [ tparam_list , ] ;
tparam_list : tparam | tparam_list , tparam ;
tparam : name tbound? tdefault? | STAR name tstar? | POW name tdefault? ;
tbound : colon expr ;
tdefault : EQ expr ;
tstar : EQ star_expr ;

params : pos | pos , | pos , stars | stars ;
pos : plain | plain , with_default | with_default ;
plain : param | plain , param | plain , SLASH ;
with_default : dparam | with_default , dparam | with_default , SLASH ;
param : name annotation? ;
dparam : name annotation? EQ expr ;
annotation : colon expr ;
stars : stars1 | stars1 , ;
stars1 : STAR star_param kwonly? kwrest? | STAR kwonly kwrest? | POW param ;
star_param : name | name colon expr | name colon STAR arith ;
kwonly : kwonly1 | kwonly kwonly1 ;
kwonly1 : , param | , dparam ;
kwrest : , POW param ;

lparams : lpos | lpos , | lpos , lstars | lstars ;
lpos : lplain | lplain , ldefault | ldefault ;
lplain : name | lplain , name | lplain , SLASH ;
ldefault : name EQ expr | ldefault , name EQ expr | ldefault , SLASH ;
lstars : lstars1 | lstars1 , ;
lstars1 : STAR name lkw? lrest? | STAR lkw lrest? | POW name ;
lkw : lkw1 | lkw lkw1 ;
lkw1 : , name | , name EQ expr ;
lrest : , POW name ;

match_stmt : match subject colon NEWLINE INDENT case_block+ DEDENT ;
subject : named | star_named , | star_named , star_named_list ;
case_block : case patterns guard? colon block ;
guard : if named ;
patterns : as_pattern | seq_item , | seq_item , seq_items ;
seq_items : seq_list | seq_list , ;
seq_list : seq_item | seq_list , seq_item ;
seq_item : as_pattern | STAR name ;
as_pattern : or_pattern | or_pattern as name ;
or_pattern : closed | or_pattern VBAR closed ;
closed : number | strings | None | True | False | name | attr | ( as_pattern ) | ( ) | ( seq_item , ) | ( seq_item , seq_items )
 | [ ] | [ seq_items ] | { } | { pairs } | { pairs , } | cls ( ) | cls ( pat_args ) | cls ( pat_args , ) ;
number : NUMBER | PM NUMBER | NUMBER PM NUMBER | PM NUMBER PM NUMBER ;
attr : name . name | attr . name ;
cls : name | attr ;
pairs : pair | pairs , pair ;
pair : pair_key colon as_pattern | POW name ;
pair_key : number | strings | None | True | False | attr ;
pat_args : pat_pos | pat_pos , pat_kw | pat_kw ;
pat_pos : as_pattern | pat_pos , as_pattern ;
pat_kw : name EQ as_pattern | pat_kw , name EQ as_pattern ;

star_exprs : star_expr_list | star_expr_list , ;
star_expr_list : star_expr | star_expr_list , star_expr ;
star_expr : expr | STAR arith ;
star_named_list : star_nameds | star_nameds , ;
star_nameds : star_named | star_nameds , star_named ;
star_named : named | STAR arith ;
named : expr | name WALRUS expr ;
expr : disj | disj if disj else expr | lambda lparams? colon expr ;
disj : inv | disj BOOL inv ;
inv : not inv | comp ;
comp : arith | comp compop arith ;
compop : CMP | in | not in | is | is not ;
arith : unary | arith binop unary ;
binop : BIN | PM | STAR | AT | VBAR | SLASH ;
unary : PM unary | TILDE unary | power ;
power : awaited | awaited POW unary ;
awaited : await primary | primary ;
primary : atom | primary . name | primary ( args? ) | primary ( genexp ) | primary [ slices ] ;
atom : name | NUMBER | strings | None | True | False | DOTS | ( ) | ( yield_expr ) | ( named ) | ( star_named , ) | ( star_named , star_named_list ) | ( genexp )
 | [ ] | [ star_named_list ] | [ genexp ] | { } | { star_named_list } | { genexp } | { kvs } | { kvs , } | { expr colon expr comp_for+ } ;
kvs : kv | kvs , kv ;
kv : expr colon expr | POW arith ;
genexp : named comp_for+ ;
comp_for : for targets in disj comp_if* | async for targets in disj comp_if* ;
comp_if : if disj ;
args : arg_list | arg_list , ;
arg_list : pargs | pargs , kargs | kargs ;
pargs : parg | pargs , parg ;
parg : named | STAR expr ;
kargs : name EQ expr | POW expr | kargs , karg ;
karg : name EQ expr | POW expr | STAR expr ;
slices : slice_list | slice_list , ;
slice_list : slice | slice_list , slice ;
slice : named | STAR arith | expr? colon expr? | expr? colon expr? colon expr? ;
name : NAME | match | case | type ;
strings : string1 | strings string1 ;
string1 : STRING | FSTART field* FEND ;
field : FLB field_value FEQ? FCONV? spec? FRB ;
field_value : star_exprs | yield_expr ;
spec : FCOLON field* ;
"""

KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
)
_KIND = {"and": "BOOL", "or": "BOOL"} | {k: k for k in KEYWORDS if k not in ("and", "or")}
_OPS = {
    "+": "PM", "-": "PM", "*": "STAR", "**": "POW", "/": "SLASH", "//": "BIN", "%": "BIN", "@": "AT", "<<": "BIN", ">>": "BIN", "&": "BIN", "^": "BIN", "|": "VBAR", "~": "TILDE",
    "<": "CMP", ">": "CMP", "<=": "CMP", ">=": "CMP", "==": "CMP", "!=": "CMP", "=": "EQ", ":=": "WALRUS", "->": "ARROW", "...": "DOTS", ":": "colon", ";": "semi", ".": ".", ",": ",",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
} | {op + "=": "AUG" for op in ("+", "-", "*", "**", "/", "//", "%", "@", "<<", ">>", "&", "^", "|")}
_CLOSE = {")": "(", "]": "[", "}": "{"}
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*)[jJ]?|[0-9](?:_?[0-9])*[jJ]?)"
_TOKEN = re.compile(
    r"(?P<SPACE>[ \t\f]+|\\\n)|(?P<COMMENT>#[^\n]*)|(?P<NL>\n)|(?P<STR>(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:'''|\"\"\"|'|\"))|(?P<NAME>[^\W\d]\w*)|(?P<NUMBER>" + _NUMBER + r")"
    r"|(?P<OP>\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=:;.,()\[\]{}])"
)
#: The same with white space before it, for the main loop.
_SPACED = re.compile(r"[ \t\f]*(?:" + _TOKEN.pattern.replace(r"(?P<SPACE>[ \t\f]+|\\\n)", r"(?P<SPACE>\\\n|\Z)") + ")")
_BAD_OCTAL = re.compile(r"0[0-9_]*[1-9][0-9_]*")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:10|0[0-9a-fA-F])[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_BAD_BYTE = re.compile(r"\\x(?![0-9a-fA-F]{2})")
_TAIL = {
    "'": re.compile(r"(?:[^'\\\n]|\\.)*'", re.S), '"': re.compile(r'(?:[^"\\\n]|\\.)*"', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S), '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
}
_INDENT = re.compile(r"[ \t\f]*")


class _Bad(Exception):
    pass


def _escapes_ok(text: str) -> bool:
    if "\\" not in text:
        return True
    plain = text.replace("\\\\", "")
    if _BAD_ESCAPE.search(plain):
        return False
    for m in re.finditer(r"\\N\{([^}]+)\}", plain):
        try:
            unicodedata.lookup(m[1])
        except KeyError:
            return False
    return True


class _Lexer:
    def __init__(self, text: str):
        self.s, self.line, self.out = text, 1, []

    def emit(self, kind: str) -> None:
        self.out.append((kind, self.line, False))

    def string(self, at: int, opening: str) -> int:
        """Reads a string literal whose opening ends at ``at``."""
        quote = opening.lstrip("rRuUbBfF")
        prefix = opening[: len(opening) - len(quote)].lower()
        if "f" in prefix:
            self.emit("FSTART")
            at = self.literal(at, quote, "r" in prefix, 0)
            self.emit("FEND")
            return at
        m = _TAIL[quote].match(self.s, at)
        if m is None:
            raise _Bad
        self.emit("STRING")
        body = m[0]
        if "b" in prefix:
            if not body.isascii() or "r" not in prefix and _BAD_BYTE.search(body.replace("\\\\", "")):
                raise _Bad
        elif "r" not in prefix and not _escapes_ok(body):
            raise _Bad
        self.line += body.count("\n")
        return m.end()

    def literal(self, at: int, quote: str, raw: bool, level: int) -> int:
        """The literal parts and fields of an f-string up to its quote, or, in a format spec (level > 0), up to the closing brace."""
        s, n = self.s, len(self.s)
        begun = at
        while True:
            if at >= n:
                raise _Bad
            c = s[at]
            if level and c == "}":
                return at
            if s.startswith(quote, at):
                if level:
                    raise _Bad
                if not raw and not _escapes_ok(s[begun:at]):
                    raise _Bad
                return at + len(quote)
            if c == "\n":
                if len(quote) == 1:
                    raise _Bad
                self.line += 1
                at += 1
            elif c == "\\" and at + 1 < n:
                if not raw and s.startswith("N{", at + 1):
                    end = s.find("}", at)
                    if end < 0:
                        raise _Bad
                    at = end + 1
                elif s[at + 1] in "{}":
                    at += 1
                else:
                    self.line += s[at + 1] == "\n"
                    at += 2
            elif c == "{":
                if not level and s.startswith("{{", at):
                    at += 2
                    continue
                if not raw and not _escapes_ok(s[begun:at]):
                    raise _Bad
                if level > 2:
                    raise _Bad
                self.emit("FLB")
                at = self.code(at + 1, quote, raw, level)
                begun = at
            elif c == "}":
                if not s.startswith("}}", at):
                    raise _Bad
                at += 2
            else:
                at += 1

    def code(self, at: int, quote: str, raw: bool, level: int) -> int:
        """The tokens of a replacement field, to behind its closing brace."""
        depth: list[str] = []
        s = self.s
        while True:
            if at >= len(s):
                raise _Bad
            c = s[at]
            if not depth:
                if c == "}":
                    self.emit("FRB")
                    return at + 1
                if c == ":":
                    self.emit("FCOLON")
                    at = self.literal(at + 1, quote, raw, level + 1)
                    continue
                if c == "!" and not s.startswith("!=", at):
                    m = re.compile(r"!(\w+)[ \t]*").match(s, at)
                    if m is None or m[1] not in ("r", "s", "a"):
                        raise _Bad
                    self.emit("FCONV")
                    at = m.end()
                    continue
                if c == "=" and not s.startswith("==", at):
                    m = re.compile(r"=\s*(?=[!:}])").match(s, at)
                    if m:
                        self.emit("FEQ")
                        self.line += m[0].count("\n")
                        at = m.end()
                        continue
            m = _TOKEN.match(s, at)
            if m is None:
                raise _Bad
            at = self.token(m, depth)

    def token(self, m: re.Match, depth: list[str]) -> int:
        """One token inside brackets or a line; line ends are white space here."""
        kind, text = m.lastgroup, m[0]
        if kind == "NAME":
            if not text.isascii() and not unicodedata.normalize("NFKC", text).isidentifier():
                raise _Bad
            self.emit(_KIND.get(text, "NAME"))
        elif kind == "OP":
            if text in "([{":
                depth.append(text)
                if len(depth) > 200:
                    raise _Bad
            elif text in ")]}":
                if not depth or depth.pop() != _CLOSE[text]:
                    raise _Bad
            self.emit(_OPS[text])
        elif kind == "NUMBER":
            end = m.end()
            if _BAD_OCTAL.fullmatch(text):
                raise _Bad
            nxt = self.s[end : end + 1]
            if (nxt.isalnum() or nxt == "_") and not _AFTER_NUMBER.match(self.s, end):
                raise _Bad
            self.emit("NUMBER")
        elif kind == "STR":
            return self.string(m.end(), text)
        elif kind in ("NL",) or text == "\\\n":
            self.line += 1
        return m.end()

    def run(self) -> None:
        s, n, at = self.s, len(self.s), 0
        indents, alts, depth = [0], [0], []
        match, match_one, add = _SPACED.match, _TOKEN.match, self.out.append
        start = True
        while at < n:
            if start:
                m = _INDENT.match(s, at)
                white = m[0]
                at = m.end()
                if at >= n:
                    break
                c = s[at]
                if c == "\n":
                    self.line += 1
                    at += 1
                    continue
                if c == "#":
                    end = s.find("\n", at)
                    at = n if end < 0 else end
                    continue
                if "\f" in white:
                    white = white[white.rindex("\f") + 1 :]
                if "\t" in white:
                    col = alt = 0
                    for w in white:
                        col, alt = (col // 8 * 8 + 8, alt + 1) if w == "\t" else (col + 1, alt + 1)
                else:
                    col = alt = len(white)
                if col == indents[-1]:
                    if alt != alts[-1]:
                        raise _Bad
                elif col > indents[-1]:
                    if alt <= alts[-1] or len(indents) >= 100:
                        raise _Bad
                    indents.append(col)
                    alts.append(alt)
                    self.emit("INDENT")
                else:
                    while col < indents[-1]:
                        indents.pop()
                        alts.pop()
                        self.emit("DEDENT")
                    if col != indents[-1] or alt != alts[-1]:
                        raise _Bad
                start = False
                if s.startswith("\\\n", at) and s[at + 2 :].strip(" \t\f") == "":
                    raise _Bad
            m = match(s, at)
            if m is None:
                raise _Bad
            kind = m.lastgroup
            if kind == "NAME":
                text = m["NAME"]
                if not text.isascii() and not unicodedata.normalize("NFKC", text).isidentifier():
                    raise _Bad
                add((_KIND.get(text, "NAME"), self.line, False))
                at = m.end()
            elif kind == "OP":
                text = m["OP"]
                if text in "([{":
                    depth.append(text)
                    if len(depth) > 200:
                        raise _Bad
                elif text in ")]}" and (not depth or depth.pop() != _CLOSE[text]):
                    raise _Bad
                add((_OPS[text], self.line, False))
                at = m.end()
            elif kind == "NL":
                if not depth:
                    self.emit("NEWLINE")
                    start = True
                self.line += 1
                at = m.end()
            elif kind == "STR":
                at = self.string(m.end(), m["STR"])
            elif kind == "NUMBER":
                at = self.token(match_one(s, m.start("NUMBER")), depth)
            else:
                if m["SPACE"] == "\\\n":
                    self.line += 1
                    if m.end() >= n:
                        raise _Bad
                at = m.end()
        if depth:
            raise _Bad
        if not start:
            self.emit("NEWLINE")
        for _ in indents[1:]:
            self.emit("DEDENT")


def tokens(body: str):
    text = body.replace("\r\n", "\n").replace("\r", "\n")
    lexer = _Lexer(text)
    try:
        if "\0" in text:
            raise _Bad
        lexer.run()
    except _Bad:
        lexer.emit("BAD")
    return lexer.out
