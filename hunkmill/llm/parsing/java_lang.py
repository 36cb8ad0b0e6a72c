"""Java (with records, sealed types, switch patterns and text blocks): grammar and token stream."""

from __future__ import annotations

import re

GRAMMAR = """
%shift else ;
unit : package_part? import_decl* type_or_semi* ;
package_part : package_head qname ';' ;
package_head : annotation* package ;
import_decl : import static? qname ';' | import static? qname . STAR ';' ;
type_or_semi : type_decl | ';' ;
type_decl : modifier* type_body ;
type_body : class name tparams? extends_part? implements_part? permits_part? class_body
 | interface name tparams? extends_list? permits_part? class_body
 | enum name implements_part? enum_body
 | at interface name class_body
 | record name tparams? ( params ) implements_part? class_body ;
modifier : annotation | public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | sealed | non_sealed ;
annotation : at qname | at qname ( ) | at qname ( annotation_args ) ;
annotation_args : annotation_value | pairs ;
pairs : pair | pairs , pair ;
pair : name = annotation_value ;
annotation_value : cond | annotation | { } | { annotation_values } | { annotation_values , } | { , } ;
annotation_values : annotation_value | annotation_values , annotation_value ;
extends_part : extends type ;
extends_list : extends type_list ;
implements_part : implements type_list ;
permits_part : permits type_list ;
type_list : type | type_list , type ;
tparams : < tparam_list > ;
tparam_list : tparam | tparam_list , tparam ;
tparam : annotation* name | annotation* name extends bounds ;
bounds : type | bounds AND type ;
class_body : { class_member* } ;
class_member : ';' | block | static block | modifier* member | type_decl ;
member : type declarators ';' | tparams? type name ( params ) dims? throws_part? method_body
 | tparams? void name ( params ) throws_part? method_body | tparams? name ( params ) throws_part? block | name block ;
method_body : block | ';' | default annotation_value ';' ;
throws_part : throws type_list ;
enum_body : { enum_constants? enum_rest? } | { enum_constants , enum_rest? } | { , enum_rest? } ;
enum_constants : enum_constant | enum_constants , enum_constant ;
enum_constant : annotation* name args? class_body? ;
enum_rest : ';' class_member* ;
params : %empty | param_list ;
param_list : param | param_list , param ;
param : var_mod* type name dims? | var_mod* type ... name | var_mod* type this | var_mod* type name . this ;
var_mod : annotation | final ;

type : simple_type | simple_type dims ;
simple_type : prim | class_type ;
prim : byte | short | int | long | float | double | boolean | char ;
class_type : qname | qname targs | class_type . name | class_type . name targs ;
targs : < > | < targ_list > ;
targ_list : targ | targ_list , targ ;
targ : type | ? | ? extends type | ? super type | annotation targ ;
dims : dim | dims dim ;
dim : [ ] ;
qname : name | qname . name ;
name : NAME | record | sealed | permits | var | yield | when ;

declarators : declarator | declarators , declarator ;
declarator : name dims? | name dims? = initializer ;
initializer : assign | array_init ;
array_init : { } | { initializers } | { initializers , } | { , } ;
initializers : initializer | initializers , initializer ;

block : { block_item* } ;
block_item : stmt | local_var ';' | local_type ;
local_type : local_mod* type_body ;
local_mod : annotation | final | abstract | static | strictfp | sealed | non_sealed ;
local_var : var_mod* type declarators ;
stmt : block | ';' | sexpr ';' | if ( expr ) stmt | if ( expr ) stmt else stmt | while ( expr ) stmt | do stmt while ( expr ) ';'
 | for ( for_init ';' expr? ';' sexprs? ) stmt | for ( var_mod* type name dims? : expr ) stmt | switch ( expr ) switch_body | return expr? ';' | break name? ';' | continue name? ';'
 | throw expr ';' | synchronized ( expr ) block | assert expr ';' | assert expr : expr ';' | name : stmt | yield expr ';'
 | try block catches | try block catches? finally block | try ( resources ) block catches? | try ( resources ) block catches? finally block | try ( resources ';' ) block catches? | try ( resources ';' ) block catches? finally block ;
catches : catch_part | catches catch_part ;
catch_part : catch ( var_mod* catch_type name ) block ;
catch_type : type | catch_type OR type ;
resources : resource | resources ';' resource ;
resource : var_mod* type name = expr | postfix ;
for_init : %empty | sexprs | local_var ;
sexprs : sexpr | sexprs , sexpr ;
sexpr : assignment | INC unary | postfix INC | call | creation ;
switch_body : { } | { groups } | { rules } ;
groups : group | groups group ;
group : label : block_item* ;
label : case case_items | case case_items guard | default ;
guard : when expr ;
case_items : case_item | case_items , case_item ;
case_item : cond | pattern | default ;
rules : rule | rules rule ;
rule : label -> expr ';' | label -> block | label -> throw expr ';' ;
pattern : var_mod* type name | var_mod* type ( ) | var_mod* type ( patterns ) ;
patterns : pattern | patterns , pattern ;

expr : assign ;
assign : cond | assignment | lambda ;
assignment : postfix = assign | postfix AOP assign | postfix > > = assign ;
lambda : name -> lambda_body | ( ) -> lambda_body | ( lambda_names ) -> lambda_body | ( param_list ) -> lambda_body ;
lambda_names : name | lambda_names , name ;
lambda_body : expr | block ;
cond : binary | binary ? expr : cond | binary ? expr : lambda ;
binary : unary | binary binop unary | binary instanceof type | binary instanceof pattern ;
binop : BIN | PM | STAR | AND | OR | < | > | > > | > > > ;
unary : postfix | postfix INC | PM unary | UN unary | INC unary | cast ;
cast : ( prim dims? ) unary | ( cast_type ) cast_operand | ( cast_type ) lambda | ( prim dims? ) lambda ;
cast_type : class_type | class_type dims | cast_type AND type ;
cast_operand : postfix | postfix INC | UN unary | cast ;
postfix : primary | qname | switch_expr ;
switch_expr : switch ( expr ) switch_body ;
primary : literal | this | qname . this | super . name | qname . super . name | ( expr ) | creation | call | primary . name | primary [ expr ] | qname [ expr ] | type . class | void . class | class_ref
 | postfix '::' name | postfix '::' new | type '::' name | type '::' new | super '::' name ;
class_ref : qname . class ;
literal : NUMBER | STRING | CHAR | true | false | null ;
call : name args | qname . name args | primary . name args | primary . targs name args | qname . targs name args | super . name args | super . targs name args | this args | super args | primary . super args | qname . super args
 | qname . super . name args | this . targs name args ;
args : ( ) | ( arg_list ) ;
arg_list : expr | arg_list , expr ;
creation : new annotation* class_type args class_body? | new targs class_type args class_body? | new annotation* array_type dims array_init | new annotation* array_type dim_exprs dims? | postfix . new class_type args class_body? ;
array_type : prim | class_type ;
dim_exprs : dim_expr | dim_exprs dim_expr ;
dim_expr : [ expr ] ;
"""
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package"
    " private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits var yield when _".split()
)
_BIN = frozenset("/ % == != <= >= << ^ && ||".split())
_AOP = frozenset("+= -= *= /= %= <<= >>= >>>= &= |= ^=".split())
_TOKEN = re.compile(
    r"(?P<SPACE>[ \t\f\x1a]+)|(?P<NL>\r\n|[\n\r])|(?P<COMMENT>//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)"
    r"|(?P<HYPHEN>non-sealed\b)|(?P<NAME>(?:[^\W\d]|\$)(?:\w|\$)*)"
    r"|(?P<NUMBER>0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?(?![\w.])|0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9]+[fFdD]?|0[bB][01](?:_*[01])*[lL]?|(?:[0-9](?:_*[0-9])*\.(?:[0-9](?:_*[0-9])*)?|\.[0-9](?:_*[0-9])*)(?:[eE][+-]?[0-9]+)?[fFdD]?|[0-9](?:_*[0-9])*(?:[eE][+-]?[0-9]+[fFdD]?|[fFdDlL])?)"
    r'|(?P<TEXT>"""[ \t\f]*(?:\r\n|\n|\r)(?:[^"\\]|\\[\s\S]|"(?!""))*""")'
    r"|(?P<STRING>\"(?:[^\"\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*\")|(?P<CHAR>'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    r"|(?P<OP>>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.()\[\]{}@])"
)


def tokens(body: str):
    out: list[tuple[str, int, bool]] = []
    add = out.append
    at, line, n = 0, 1, len(body)
    match = _TOKEN.match
    while at < n:
        m = match(body, at)
        if m is None:
            add(("BAD", line, False))
            return out
        kind, text = m.lastgroup, m[0]
        at = m.end()
        if kind == "SPACE":
            continue
        if kind == "NL":
            line += 1
            continue
        if kind == "COMMENT":
            line += text.count("\n")
            continue
        if kind == "NAME":
            if text in KEYWORDS:
                kind = text if text != "_" else "NAME"
        elif kind == "HYPHEN":
            kind = "non_sealed"
        elif kind == "NUMBER":
            nxt = body[at : at + 1]
            octal = len(text) > 1 and text[0] == "0" and text[1:].strip("lL_").isdigit() and any(c in "89" for c in text)
            if nxt.isalnum() or nxt in ("_", "$") and nxt or octal:
                add(("BAD", line, False))
                return out
        elif kind == "TEXT":
            add(("STRING", line, False))
            line += text.count("\n")
            continue
        elif kind == "OP":
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
                kind = "INC"
            elif text == "&":
                kind = "AND"
            elif text == "|":
                kind = "OR"
            elif text == "@":
                kind = "at"
        add((kind, line, False))
    return out
