"""JavaScript (script or module): grammar and token stream. Automatic semicolons are put in by the parser."""

from __future__ import annotations

import re

#: A brace, ``function`` or ``class`` that stands where a statement may begin opens a block or a declaration.
FIRST = {"{": "{b", "function": "functionb", "class": "classb"}
VIRTUAL, CLOSERS = "ASI", frozenset(["}", "$end"])

GRAMMAR = """
%shift else ;
program : item* ;
item : stmt | import_stmt | export_stmt ;
body : {b stmt* } ;
semi : ';' | ASI ;
stmt : body | declaration | variable semi | ';' | exprs semi | if ( exprs ) stmt | if ( exprs ) stmt else stmt
 | for ( for_init ';' exprs? ';' exprs? ) stmt | for ( for_left in exprs ) stmt | for await? ( for_left of assign ) stmt
 | while ( exprs ) stmt | do stmt while ( exprs ) | do stmt while ( exprs ) semi | continue name? semi | break name? semi | return exprs? semi | throw exprs semi
 | with ( exprs ) stmt | switch ( exprs ) {b case_part* } | name : stmt | try body catch_part | try body finally body | try body catch_part finally body | debugger semi ;
case_part : case exprs : stmt* | default : stmt* ;
catch_part : catch body | catch ( binding ) body ;
declaration : functionb STAR? name ( params ) body | async functionb STAR? name ( params ) body | async function STAR? name ( params ) body | classb name heritage? {b member* } ;
variable : var_kind declarators ;
var_kind : var | let | const ;
declarators : declarator | declarators , declarator ;
declarator : binding | binding = assign ;
for_init : %empty | exprs | variable ;
for_left : lhs | var_kind binding ;
binding : name | pattern ;
pattern : '{' '}' | '{' pattern_props '}' | '{' pattern_props , '}' | [ pattern_items ] ;
pattern_props : pattern_prop | pattern_props , pattern_prop ;
pattern_prop : name | name = assign | prop_name : binding | prop_name : binding = assign | ... name ;
pattern_items : pattern_item | pattern_items , pattern_item ;
pattern_item : %empty | binding | binding = assign | ... binding ;
params : %empty | param_list | param_list , ;
param_list : param | param_list , param ;
param : binding | binding = assign | ... binding ;

import_stmt : import STRING with_part? semi | import import_what from STRING with_part? semi ;
with_part : with object ;
import_what : name | named_imports | STAR as name | name , named_imports | name , STAR as name ;
named_imports : '{' '}' | '{' specs '}' | '{' specs , '}' | {b } | {b specs } | {b specs , } ;
specs : spec | specs , spec ;
spec : any_name | any_name as any_name | STRING as any_name ;
export_stmt : export STAR from STRING semi | export STAR as any_name from STRING semi | export named_imports semi | export named_imports from STRING semi
 | export declaration | export variable semi | export default assign semi | export default declaration | export default anon ;
anon : functionb STAR? ( params ) body | async functionb STAR? ( params ) body | classb heritage? {b member* } ;

heritage : extends primary ;
member : ';' | mods prop_name ( params ) body | field semi | static body ;
field : mods prop_name | mods prop_name = assign ;
mods : %empty | mods mod ;
mod : static | async | get | set | STAR ;

exprs : assign | exprs , assign ;
assign : cond | arrow | lhs = assign | lhs AOP assign | yield | yield assign | yield STAR assign ;
arrow : paren => arrow_body | ( ) => arrow_body | name => arrow_body | async args => arrow_body | async name => arrow_body ;
arrow_body : assign | body ;
cond : binary | binary ? assign : assign ;
binary : unary | binary binop unary ;
binop : BIN | PM | STAR | in | instanceof ;
unary : postfix | unop unary ;
unop : UN | PM | INC | PREINC | typeof | void | delete | await ;
postfix : primary | lhs INC ;
lhs : name | primary . any_name | primary [ exprs ] | paren | array | object | new . name | import . name ;
primary : atom | primary . any_name | primary ?. any_name | primary ?. [ exprs ] | primary ?. args | primary [ exprs ] | primary args | primary template | new_expr ;
new_expr : new atom | new new_tail args? | new new_atom args ;
new_atom : atom ;
new_tail : atom . any_name | new_tail . any_name | atom [ exprs ] | new_tail [ exprs ] ;
atom : name | NUMBER | STRING | REGEX | template | this | super | null | true | false | paren | array | object | fn | import ( exprs ) | import . name | new . name ;
paren : ( exprs ) | ( exprs , ) | ( rest ) | ( exprs , rest ) ;
rest : ... binding ;
args : ( ) | ( arg_list ) | ( arg_list , ) ;
arg_list : arg | arg_list , arg ;
arg : assign | ... assign ;
array : [ elements ] ;
elements : element | elements , element ;
element : %empty | assign | ... assign ;
object : '{' '}' | '{' props '}' | '{' props , '}' ;
props : prop | props , prop ;
prop : prop_name : assign | name | name = assign | ... assign | mods prop_name ( params ) body ;
prop_name : any_name | STRING | NUMBER | [ assign ] ;
fn : function STAR? name? ( params ) body | async function STAR? name? ( params ) body | class name? heritage? {b member* } ;
template : TPL | THEAD exprs template_mid* TTAIL ;
template_mid : TMID exprs ;
name : NAME | of | async | get | set | static | from | as ;
any_name : name | let | reserved | true | false | null | this | super | PRIVATE ;
reserved : break | case | catch | class | classb | const | continue | debugger | default | delete | do | else | export | extends | finally | for | function | functionb | if | import | in | instanceof
 | new | return | switch | throw | try | typeof | var | void | while | with | yield | await | enum ;
"""
GRAMMAR = GRAMMAR.replace("'{' ", "{ ").replace(" '}'", " }")

KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return switch throw try typeof var void while with yield await enum"
    " let static async get set of from as this super null true false".split()
)
_RESERVED = KEYWORDS - frozenset("let static async get set of from as yield await this super null true false".split())
_BIN = frozenset("/ % ** == != === !== < > <= >= << >> >>> & | ^ && || ??".split())
_AOP = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_TOKEN = re.compile(
    r"(?P<SPACE>[ \t\v\f\u00a0\ufeff]+)|(?P<NL>\r\n|[\n\r\u2028\u2029])|(?P<COMMENT>//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)"
    r"|(?P<NAME>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<NUMBER>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?|(?:[0-9](?:_?[0-9])*n|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?))"
    r"|(?P<STRING>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    r"|(?P<TICK>`)"
    r"|(?P<OP>>>>=|\*\*=|===|!==|>>>|<<=|>>=|&&=|\|\|=|\?\?=|\.\.\.|=>|\*\*|==|!=|<=|>=|<<|>>|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.()\[\]{}])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<END>`|\$\{)")


_CONTROL = frozenset("if for while switch with catch".split())


def tokens(body: str, can):
    """The token stream. ``can`` asks the parser what may come next: it decides whether a slash divides or opens a regular expression.

    ``return`` outside every function body and a line end behind ``throw`` give a token that no parse takes. Not looked at: names that are
    declared twice, ``??`` beside ``||`` and ``&&``, labels, and rules of strict mode.
    """
    out: list[tuple[str, int, bool]] = []
    add = out.append
    at, line, n = 0, 1, len(body)
    fresh, prev = False, ""
    braces: list[str] = []  # "{", "f" for a function body, or "`" for a template's field
    parens: list[str] = []  # what stands before each open parenthesis
    closed_after, inside = "", 0
    match = _TOKEN.match
    if body.startswith("#!"):
        at = len(body.split("\n", 1)[0])
    while at < n:
        if out:
            yield from out
            out.clear()
        m = match(body, at)
        if m is None:
            yield "BAD", line, False
            return
        kind, text = m.lastgroup, m[0]
        end = m.end()
        if kind == "SPACE":
            at = end
            continue
        if kind == "NL":
            line += 1
            fresh = True
            at = end
            continue
        if kind == "COMMENT":
            k = text.count("\n")
            if k:
                line += k
                fresh = True
            at = end
            continue
        if fresh and prev in ("return", "break", "continue"):
            add(("ASI", line, False))
        elif fresh and prev == "throw" and text not in (":", "("):
            yield "BAD", line, False
            return
        if kind == "NAME":
            if text[0] == "#":
                kind = "PRIVATE"
            elif text in KEYWORDS:
                kind = "NAME" if prev in (".", "?.") else text
                if text == "return" and kind == text and not inside and prev in (";", "}", "", ")", "{") and "{" not in braces[:-1] and body[end : end + 1] not in (":", "("):
                    yield "BAD", line, False
                    return
        elif kind == "NUMBER":
            nxt = body[end : end + 1]
            if nxt.isalnum() or nxt in ("_", "$") and nxt:
                yield "BAD", line, False
                return
        elif kind == "STRING":
            line += text.count("\n")
        elif kind == "TICK" or text == "}" and braces and braces[-1] == "`":
            if text == "}":
                braces.pop()
            t = _TEMPLATE.match(body, end)
            if t is None:
                yield "BAD", line, False
                return
            closed = t["END"] == "`"
            kind = ("TPL" if closed else "THEAD") if text == "`" else ("TTAIL" if closed else "TMID")
            if not closed:
                braces.append("`")
            add((kind, line, fresh))
            line += t[0].count("\n")
            fresh, prev, at = False, "TPL" if closed else "(", t.end()
            continue
        else:
            if text == "/" or text == "/=":
                yield from out  # so that the parser stands where this token is to be read
                out.clear()
                divides = can("BIN" if text == "/" else "AOP")
                if not divides:
                    r = _REGEX.match(body, at)
                    if r is None:
                        yield "BAD", line, False
                        return
                    add(("REGEX", line, fresh))
                    fresh, prev, at = False, "REGEX", r.end()
                    continue
            if text == "(":
                parens.append(prev)
            elif text == ")" and parens:
                closed_after = parens.pop()
            if text == "{":
                of_function = prev == "=>" or prev == ")" and closed_after not in _CONTROL
                braces.append("f" if of_function else "{")
                inside += of_function
            elif text == "}":
                if not braces:
                    yield "BAD", line, False
                    return
                inside -= braces.pop() == "f"
            kind = text
            if text in _BIN:
                kind = "BIN"
            elif text in _AOP:
                kind = "AOP"
            elif text in ("+", "-"):
                kind = "PM"
            elif text == "*":
                kind = "STAR"
            elif text in ("!", "~"):
                kind = "UN"
            elif text in ("++", "--"):
                kind = "PREINC" if fresh else "INC"
        add((kind, line, fresh))
        fresh, prev, at = False, kind, end
    yield from out
