"""Grammars of the supported languages, in the notation of `gll`.

N ends a statement where line ends count; the lexers set it only where a statement may end. OP stands for operators
that only stand between operands, ASG for compound assignments, ID NUM STR CHR for names and literals.
"""

C = """
%list file ";" "{" PP
%list stmts ";" "{" PP
%list items ","
file : ext*
ext : PP | ";" | fun | decl | "extern" STR {file} | "extern" STR decl | "extern" STR fun | ID (args) ";"?
fun : spec+ declarator kr* {stmts}
kr : spec+ declarator <"," declarator>* ";"
decl : spec+ <init <"," init>*>? ";" | "_Static_assert" (args) ";"
init : declarator attr* <"=" value>?
value : e | {inits}
inits : item <"," item>* ","? |
%list inits ","
item : <<"." ID | [e]>+ "=">? value | PP
spec : "static" | "extern" | "typedef" | "register" | "auto" | "inline" | "_Noreturn" | "_Thread_local" | qual | base | attr
qual : "const" | "volatile" | "restrict" | "_Atomic"
base : TYPE+ | ID | <"struct" | "union"> attr* ID? {fields} | <"struct" | "union"> attr* ID | "enum" ID? {enums} | "enum" ID | "typeof" (e) | "_Alignas" (args)
attr : "__attribute__" ((args)) | [[args]]
fields : field*
field : spec+ <fdecl <"," fdecl>*>? ";" | PP | ";"
fdecl : declarator <":" e>? attr* | ":" e
enums : <enum <"," enum>* ","?>?
enum : ID <"=" e>? | PP
ptr : "*" qual*
declarator : ptr* direct
direct : ID | (attr* declarator) | direct [static_? qual* e?] | direct (params)
static_ : "static"
params : <param <"," param>* <"," "...">?>? | "..."
param : spec+ <declarator | abstract>? attr*
abstract : ptr+ adirect? | adirect
adirect : (abstract) | [e?] | (params) | adirect [e?] | adirect (params)
stmts : stmt*
stmt : decl | e? ";" | {stmts} | PP | label stmt? | "if" (cond) stmt <"else" stmt>? | "while" (e) stmt | "do" stmt "while" (e) ";"
  | "for" (<decl | e? ";"> e? ";" e?) stmt | "switch" (e) stmt | "return" value? ";" | "break" ";" | "continue" ";" | "goto" ID ";" | "asm" qual* (args) ";"
cond : e
label : "case" e <"..." e>? ":" | "default" ":" | ID ":"
e : ternary <"," ternary>*
ternary : binary <"?" e? ":" ternary>?
binary : unary <bop unary>*
bop : OP | ASG | "=" | "*" | "&" | "+" | "-" | "<" | ">" | ">" ">"
unary : pre* post
pre : "+" | "-" | "!" | "~~" | "*" | "&" | "++" | "--" | (spec+ abstract?) | "sizeof"
post : prim suf*
suf : [e] | (args) | "." ID | "->" ID | "++" | "--"
prim : ID | NUM | str | CHR | (e) | (spec+ abstract?) {inits} | ({stmts}) | "sizeof" (spec+ abstract?) | "_Generic" (args) | "_Alignof" (spec+ abstract?)
str : <STR ID?>+ | ID STR
args : items | items ","
items : arg <"," arg>* |
arg : ternary | spec+ abstract? | {stmts}
"""

CPP = """
%list file ";" "{" PP
%list stmts ";" "{" PP
%list members ";" "{" ":" PP
%list items ","
%list inits ","
file : ext*
ext : PP | ";" | "inline"? "namespace" <ID <"::" "inline"? ID>*>? attr* {file} | "namespace" ID "=" name ";" | "extern" STR {file} | "extern" STR ext | template ext | template* fun | decl | "using" <"namespace" name | name | ID attr* "=" type> ";" | "static_assert" (args) ";" | "export" ext | ID (args) ";"? | template concept | enumd
concept : "concept" ID "=" e ";"
template : "template" "<" <tparam <"," tparam>*>? ">" <"requires" e>?
tparam : <"typename" | "class"> "..."? ID? <"=" type>? | template <"typename" | "class"> "..."? ID? <"=" name>? | type "..."? ID? <"=" unary>? | name ID <"=" type>?
fun : spec* declarator tail* <body | "=" <"default" | "delete" | NUM> ";"> | spec* declarator tail* "try" {stmts} catch+
body : <":" minit <"," minit>*>? {stmts}
minit : name <(args) | {args}> "..."?
tail : "const" | "noexcept" | "noexcept" (e) | "override" | "final" | "&" | "&&" | "->" type | "volatile" | "throw" (types) | attr | "requires" e
types : <type <"," type>*>?
decl : spec+ <init <"," init>*>? ";"
init : declarator tail* attr* <"=" value | {args} | (args)>? | "[" 
value : e | {inits}
inits : <item <"," item>* ","?>?
item : <"." ID>? "="? value "..."? | [e] "=" value | "." ID {inits} | PP
spec : "static" | "extern" | "typedef" | "register" | "inline" | "virtual" | "explicit" | "explicit" (e) | "friend" | "constexpr" | "consteval" | "constinit" | "mutable" | "thread_local" | qual | base | attr
qual : "const" | "volatile"
attr : [[args]] | "__attribute__" ((args)) | "alignas" (args)
base : TYPE+ | "auto" | "decltype" (e) | "typename"? name | <"struct" | "class" | "union"> attr* <name "final"?>? bases? {members} | <"struct" | "class" | "union" | "enum"> attr* name | enumd
enumd : "enum" <"class" | "struct">? name? <":" type>? {enums}
enums : <enum <"," enum>* ","?>?
enum : ID attr* <"=" e>? | PP
bases : ":" basev <"," basev>*
basev : <"virtual" | "public" | "private" | "protected">* name "..."?
members : member*
member : <"public" | "private" | "protected"> ":" | template* fun | template? spec+ <fdecl <"," fdecl>*>? ";" | template member | "using" <name | ID "=" type> ";" | ";" | PP | "static_assert" (args) ";" | "friend" member
fdecl : declarator tail* attr* <":" e>? <"=" value | {args}>? | ":" e
name : "::"? part <"::" "template"? part>*
part : ID targs? | "~~" ID | "operator" opname | "operator" type
opname : OP | ASG | "=" | "*" | "&" | "+" | "-" | "<" | ">" | ">" ">" | () | [] | "!" | "~~" | "++" | "--" | "->" | "," | "new" [] | "delete" [] | "new" | "delete" | STR ID | "&&"
targs : "<" <targ <"," targ>*>? ">"
targ : type "..."? | unary "..."? | binary0
binary0 : unary <<OP | "+" | "-" | "*" | "&"> unary>+
type : spec+ abstract?
ptr : <"*" | "&" | "&&" | name "::" "*"> qual*
declarator : ptr* direct
direct : "..."? name | (declarator) | direct [e?] | direct (params) | [items] | "..."
params : <param <"," param>* <","? "...">?>? | "..."
param : spec+ <declarator | abstract>? attr* <"=" value>? | "this" param
abstract : ptr+ adirect? | adirect | ptr* "..."
adirect : (abstract) | [e?] | (params) tail* | adirect [e?] | adirect (params)
stmts : stmt*
stmt : decl | e? ";" | {stmts} | PP | label stmt? | attr stmt | "if" <"constexpr" | "!">? <"consteval" | (cond)> stmt <"else" stmt>? | "while" (cond) stmt | "do" stmt "while" (e) ";"
  | "for" (<decl | e? ";"> cond? ";" e?) stmt | "for" (<decl>? spec+ declarator ":" value) stmt | "switch" (cond) stmt | "return" value? ";" | "break" ";" | "continue" ";" | "goto" ID ";"
  | "try" {stmts} catch+ | "using" <"namespace" name | name | ID "=" type> ";" | "throw" e? ";" | <"co_return" | "co_yield"> value? ";" | "static_assert" (args) ";" | "namespace" ID "=" name ";"
catch : "catch" (param | "...") {stmts}
cond : e | <decl>? spec+ declarator <"=" value | {args}> | <decl | e ";"> e
label : "case" e <"..." e>? ":" | "default" ":" | ID ":"
e : ternary <"," ternary>*
ternary : binary <"?" e ":" ternary>? | "throw" e?
binary : unary <bop unary | ASG {inits} | "=" {inits}>*
bop : OP | ASG | "=" | "*" | "&" | "&&" | "+" | "-" | "<" | ">" | ">" ">" | "..."
unary : pre* post
pre : "+" | "-" | "!" | "~~" | "*" | "&" | "&&" | "++" | "--" | (type) | "sizeof" "..."? | "delete" | "delete" [] | "co_await"
post : prim suf*
suf : [e] | [inits] | (args) | {inits} | <"." | "->"> "template"? name | <"." | "->"> "*" unary | "++" | "--" | "..."
prim : name | NUM | str | CHR | (e) | ("..." bop unary) | (binary bop "...") | "this" | "sizeof" (type) | lambda | TYPE+ <(args) | {inits}> | "new" <(args)>? <type | (type)> <(args) | {inits}>? | CAST "<" type ">" (e) | "typeid" (args) | "noexcept" (e) | "requires" (params)? {stmts} | "alignof" (type) | "auto" <(args) | {inits}> | "typename" name <(args) | {inits}>
lambda : [<"=" | "&" | items>? <"," items>?] targs? (params)? ltail* {stmts}
ltail : "mutable" | "constexpr" | "noexcept" | "->" type | attr
str : <STR ID?>+ | ID STR
args : items | items ","
items : <arg <"," arg>*>?
arg : ternary "..."? | type "..."? | {inits} | "&" "..."? ID | PP
"""

JAVA = """
%list file ";" "{"
%list members ";" "{"
%list stmts ";" "{"
%list items ","
%list vals ","
file : <anns "package" name ";">? top*
top : "import" "static"? name <"." "*">? ";" | typ | ";" | "module" name {moddir*} | "open" "module" name {moddir*} | method | field
moddir : <ID | "open"> <"static">? name <ID name>? ";"
name : id <"." id>*
id : ID | "module" | "open" | "record" | "sealed" | "permits" | "var" | "yield" | "when" | "non"
anns : ann*
ann : "@" name <(annargs)>?
annargs : <annarg <"," annarg>* ","?>?
annarg : <id "=">? <e | ann | {annargs}>
mods : mod*
mod : ann | "public" | "private" | "protected" | "static" | "final" | "abstract" | "native" | "synchronized" | "transient" | "volatile" | "strictfp" | "default" | "sealed" | "non" "-" "sealed"
typ : mods <class | iface | enum | rec | anno>
class : "class" id tparams? <"extends" type>? <"implements" types>? <"permits" types>? {members}
iface : "interface" id tparams? <"extends" types>? <"permits" types>? {members}
enum : "enum" id <"implements" types>? {consts <";" members>?}
consts : <const <"," const>* ","?>?
const : anns id <(args)>? <{members}>?
rec : "record" id tparams? (params) <"implements" types>? {members}
anno : "@" "interface" id {members}
tparams : "<" tparam <"," tparam>* ">"
tparam : anns id <"extends" type <"&" type>*>?
types : type <"," type>*
type : anns <PRIM | ctype> dims
ctype : id targs? <"." anns id targs?>*
targs : "<" <targ <"," targ>*>? ">"
targ : type | anns "?" <<"extends" | "super"> type>?
dims : <anns []>*
members : member*
member : field | method | typ | "static"? {stmts} | ";"
field : mods type var <"," var>* ";"
var : id dims <"=" init>?
init : e | {vals}
vals : <init <"," init>*>? | init <"," init>* "," | ","
method : mods tparams? anns <"void" | type> id (params) dims <"throws" types>? <{stmts} | <"default" init>? ";"> | mods tparams? id (params)? <"throws" types>? {stmts}
params : <param <"," param>*>?
param : <ann | "final">* type <anns "...">? <id | "this" | id "." "this"> dims
stmts : stmt*
stmt : {stmts} | ";" | lvar ";" | typ | e ";" | "if" (e) stmt <"else" stmt>? | "while" (e) stmt | "do" stmt "while" (e) ";" | "for" (<lvar | es>? ";" e? ";" es?) stmt
  | "for" (<ann | "final">* type id ":" e) stmt | "return" e? ";" | "throw" e ";" | "break" id? ";" | "continue" id? ";" | "yield" e ";" | "synchronized" (e) {stmts}
  | "try" <(res <";" res>* ";"?)>? {stmts} catch* <"finally" {stmts}>? | "switch" (e) {cases} | id ":" stmt | "assert" e <":" e>? ";"
catch : "catch" (<ann | "final">* type <"|" type>* id) {stmts}
res : <ann | "final">* type id "=" e | e
es : e <"," e>*
lvar : <ann | "final">* type var <"," var>*
cases : case*
case : <"case" pats guard? | "default"> <":" stmts | "->" <e ";" | {stmts} | "throw" e ";">>
pats : pat <"," pat>*
pat : ternary0 | type id | "default" | ctype (<pat <"," pat>*>?) id?
guard : "when" e
ternary0 : binary
e : binary <"?" e ":" e>? | lambda
binary : unary <bop <unary | lambda> | "instanceof" <"final"? type id? | pat>>*
bop : OP | ASG | "=" | "|" | "&" | "+" | "-" | "*" | "<" | ">" | ">" ">" | ">" ">" ">"
unary : pre* post
pre : "+" | "-" | "!" | "~~" | "++" | "--" | (type <"&" type>*)
lambda : <id | (<id <"," id>*>?) | (params)> "->" <e | {stmts}>
post : prim suf*
suf : [e] | "." targs? id (args)? | "." "new" creator | "." "this" | "." "super" | "." "class" | "++" | "--" | "::" targs? <id | "new">
prim : id (args)? | NUM | STR | CHR | "true" | "false" | "null" | "this" (args)? | "super" (args)? | (e) | "new" creator | type "::" <id | "new"> | <PRIM | ctype> []+ "." "class" | PRIM "." "class" | "void" "." "class" | "switch" (e) {cases}
creator : anns <PRIM | ctype> <(args) <{members}>? | [e]+ []* | []+ {vals}>
args : items
items : <e <"," e>*>?
"""

CSHARP = """
%list file ";" "{"
%list members ";" "{"
%list stmts ";" "{"
%list items ","
%list vals ","
file : unit*
unit : PP | "extern" ID ID ";" | "global"? "using" <"static" | ID "=">? type ";" | "namespace" name {unit*} ";"? | "namespace" name ";" | [attrs] | typ | ";" | stmt
name : id <<"." | "::"> id>*
id : ID | "get" | "set" | "init" | "var" | "when" | "record" | "partial" | "where" | "yield" | "async" | "await" | "global" | "add" | "remove" | "value" | "file" | "required" | "and" | "or" | "not" | "nameof" | "scoped" | "from" | "select" | "orderby" | "let" | "join" | "group" | "into" | "on" | "equals" | "by" | "ascending" | "descending" | "dynamic"
attrs : <<id ":">? attr <"," attr>* ","?>?
attr : type <(args)>?
mods : <[attrs] | mod>*
mod : "public" | "private" | "protected" | "internal" | "static" | "readonly" | "sealed" | "abstract" | "virtual" | "override" | "async" | "partial" | "extern" | "unsafe" | "new" | "volatile" | "const" | "ref" | "file" | "required" | "event" | "fixed" | "implicit" | "explicit"
typ : mods <"class" | "struct" | "interface" | "record" | "record" "class" | "record" "struct" | "ref" "struct"> id tparams? <(params)>? <":" base <"," base>*>? where* <{members} ";"? | ";"> | mods "enum" id <":" type>? {enums} ";"? | mods "delegate" type id tparams? (params) where* ";"
base : type <(args)>?
where : "where" id ":" cons <"," cons>*
cons : type | "class" "?"? | "struct" | "new" () | "default" | "not" id
enums : <enum <"," enum>* ","?>? | PP
enum : <[attrs]>* id <"=" e>? | PP enum
tparams : "<" <<[attrs]>* <"in" | "out">? id <"," <"in" | "out">? id>*> ">"
type : <PRIM | tname | (tupel <"," tupel>*) | "void"> tsuf* | "ref" "readonly"? type | "delegate" "*" targs
tupel : type id?
tname : id targs? <<"." | "::"> id targs?>*
targs : "<" <type <"," type>*>? ">" | "<" "," * ">"
tsuf : "?" | "*" | [","*]
members : member*
member : PP | typ | mods type var <"," var>* ";" | mods type <iname | "this"> <[params]>? <{accs} <"=" e ";">? | "=>" e ";"> | mods type iname tparams? (params) where* fbody | mods id (params) <":" <"base" | "this"> (args)>? fbody
  | mods "~~" id () fbody | mods "operator" type (params) fbody | mods type "operator" <OP | "+" | "-" | "*" | "<" | ">" | "!" | "~~" | "++" | "--" | "&" | "true" | "false" | ">" ">"> (params) fbody | ";"
iname : <tname ".">? id
fbody : {stmts} | "=>" e ";" | ";"
accs : acc+
acc : mods <"get" | "set" | "init" | "add" | "remove"> fbody
var : id <[e]>? <"=" init>?
init : e | {vals}
vals : <val <"," val>*>? | val <"," val>* ","
val : init | [items] "=" init
params : <param <"," param>*>?
param : <[attrs]>* <"ref" | "out" | "in" | "this" | "params" | "scoped" | "readonly">* type id <"=" e>?
stmts : stmt*
stmt : PP | {stmts} | ";" | lvar ";" | lfun | typ | e ";" | "if" (e) stmt <"else" stmt>? | "while" (e) stmt | "do" stmt "while" (e) ";" | "for" (<lvar | es>? ";" e? ";" es?) stmt
  | "await"? "foreach" (<type id | type? (ids)> "in" e) stmt | "return" <"ref"? e>? ";" | "throw" e? ";" | "break" ";" | "continue" ";" | "yield" <"return" e | "break"> ";" | "goto" <id | "case" e | "default"> ";"
  | "try" {stmts} catch* <"finally" {stmts}>? | "switch" (e) {sections} | id ":" stmt | "await"? "using" (<lvar | e>) stmt | "await"? "using" lvar ";" | "lock" (e) stmt | <"checked" | "unchecked" | "unsafe"> {stmts} | "fixed" (lvar) stmt
ids : id <"," id>*
catch : "catch" <(type id?)>? <"when" (e)>? {stmts}
es : e <"," e>*
lvar : <"const" | "ref" | "readonly">* type var <"," var>*
lfun : mods type id tparams? (params) where* fbody
sections : <label+ stmt*>*
label : "case" pattern <"when" e>? ":" | "default" ":"
pattern : pat1 <<"or" | "and"> pat1>*
pat1 : "not"? pat0
pat0 : range | type id? | type? (<subpat <"," subpat>*>?) id? | type? {<subpat <"," subpat>* ","?>?} id? | <"<" | ">" | OP> shift | (pattern) | [<pattern <"," pattern>*>?] id? | ".." pattern?
subpat : <name ":">? pattern
shift : unary <<"+" | "-" | "*" | OP> unary>*
e : range <"?" e ":" e>? | lambda | query
query : "from" type? id "in" e qclause+
qclause : "from" type? id "in" e | "where" e | "select" e | "orderby" e <"ascending" | "descending">? <"," e <"ascending" | "descending">?>* | "let" id "=" e | "join" type? id "in" e "on" e "equals" e <"into" id>? | "group" e "by" e | "into" id
range : binary <".." binary?>? | ".." binary?
binary : unary <bop <unary | lambda | "throw" e> | <"is"> pattern | "as" type | "switch" {<arm <"," arm>* ","?>?} | "with" {vals}>*
arm : pattern <"when" e>? "=>" e
bop : OP | ASG | "=" | "&" | "+" | "-" | "*" | "<" | ">" | ">" ">" | ">" ">" ">"
unary : pre* post
pre : "+" | "-" | "!" | "~~" | "++" | "--" | "*" | "&" | "^" | (type) | "await" | "ref" | "throw"
lambda : <[attrs]>* <"async" | "static">* <id | type? (<lparam <"," lparam>*>?)> "=>" <e | {stmts}>
lparam : param | id
post : prim suf*
suf : "?"? [items] | "?"? "." id targs? | (args) | "++" | "--" | "!" | "->" id
prim : id targs? | PRIM | NUM | STR | CHR | "true" | "false" | "null" | "this" | "base" | (e) | (arg <"," arg>+) | "new" creator | "typeof" (type) | "default" <(type)>? | "sizeof" (type) | <"checked" | "unchecked"> (e) | "stackalloc" type <{vals}>? | [items] | "delegate" <(params)>? {stmts} | "::" id
creator : type <(args)>? <{vals}>? | type [items] [","*]* <{vals}>? | [","*] {vals} | {vals} | (args) <{vals}>?
args : items
items : <arg <"," arg>*>? | arg <"," arg>* ","
arg : <id ":">? <"ref" | "out" | "in">? <e | type id> | ".." e
"""

RUST = """
%list file ";" "{"
%list members ";" "{"
%list stmts ";" "{"
%list items ","
file : inner* item*
inner : "#" "!" [tokens]
attr : "#" [tokens]
tokens : tok*
tok : ANY | (tokens) | [tokens] | {tokens}
vis : "pub" <("crate" | "super" | "self" | "in" path)>?
item : attr* vis? item0 | attr* macro
item0 : "mod" ID <{file} | ";"> | "use" usetree ";" | "extern" "crate" ID <"as" ID>? ";" | quals "fn" ID generics? (params) ret? where? <{block} | ";"> | "struct" ID generics? <where? {fields} | (tfields) where? ";" | where? ";"> | "enum" ID generics? where? {variants} | "union" ID generics? {fields}
  | "unsafe"? "impl" generics? "!"? "const"? <type "for">? type where? {inner* members} | "unsafe"? "auto"? "trait" ID generics? <":" bounds?>? where? {members} | "type" ID generics? <":" bounds>? where? <"=" type>? where? ";" | <"static" | "static" "mut" | "const"> <ID | "_"> ":" type <"=" e>? ";" | "unsafe"? "extern" STR? {members}
quals : <"const" | "async" | "unsafe" | "extern" STR?>*
macro : path "!" ID? <{tokens} ";"? | (tokens) ";" | [tokens] ";">
usetree : <"::">? <path <"as" <ID | "_">>? | <path "::">? "*" | <path "::">? {<usetree <"," usetree>* ","?>?}>
path : "::"? seg <"::" seg>*
seg : ID | "self" | "super" | "crate" | "Self"
members : member*
member : attr* vis? "default"? item0 | attr* macro
fields : <field <"," field>* ","?>?
field : attr* vis? ID ":" type
tfields : <tfield <"," tfield>* ","?>?
tfield : attr* vis? type
variants : <variant <"," variant>* ","?>?
variant : attr* ID <{fields} | (tfields)>? <"=" e>?
generics : "<" <gparam <"," gparam>* ","?>? ">"
gparam : attr* <LIFE <":" <LIFE <"+" LIFE>*>?>? | ID <":" bounds?>? <"=" type>? | "const" ID ":" type <"=" e>?>
where : "where" <wpred <"," wpred>* ","?>?
wpred : LIFE ":" bounds | forlt? type ":" bounds?
bounds : bound <"+" bound>* "+"?
bound : LIFE | "?"? forlt? tpath | (bound)
forlt : "for" "<" <LIFE <"," LIFE>*>? ">"
ret : "->" type
params : <attr* selfp <"," param>* ","?>? | param <"," param>* ","?
selfp : "&"? LIFE? "mut"? "self" <":" type>?
param : attr* pat ":" type | attr* "..." | type
type : tpath | "&" LIFE? "mut"? type | "&&" LIFE? "mut"? type | "*" <"const" | "mut"> type | [type <";" e>?] | (<type <"," type>* ","?>?) | "!" | "_" | forlt? "unsafe"? <"extern" STR?>? "fn" (<<ID ":">? type <"," <ID ":">? type>* ","?>?) ret? | "impl" bounds | "dyn" bounds | "<" type <"as" tpath>? ">" "::" tpath | path "!" (tokens)
tpath : "::"? tseg <"::" tseg>*
tseg : seg <"::"? gargs | (<type <"," type>*>?) ret?>?
gargs : "<" <garg <"," garg>* ","?>? ">"
garg : LIFE | type | lit | {block} | ID gargs? "=" type | ID ":" bounds | "-" NUM
lit : NUM | STR | CHR | "true" | "false"
pat : "|"? pat1 <"|" pat1>*
pat1 : "_" | ".." | "-"? lit <<"..=" | ".." | "..."> <"-"? lit | epath>?>? | <"..=" | ".."> "-"? lit | "ref"? "mut"? ID <"@" pat1>? | epath <<"..=" | ".."> <lit | epath>?>? | epath (<pat <"," pat>* ","?>?) | epath {fpats} | (<pat <"," pat>* ","?>?) | [<pat <"," pat>* ","?>?] | <"&" | "&&"> "mut"? pat1 | path "!" (tokens) | "box" pat1
fpats : <fpat <"," fpat>* ","?>?
fpat : attr* <"ref"? "mut"? ID | <ID | NUM> ":" pat | "..">
block : inner* stmts e?
stmts : stmt*
stmt : ";" | item | attr* "let" pat <":" type>? <"=" e <"else" {block}>?>? ";" | attr* e ";" | attr* blocky | path "!" <{tokens}>
blocky : LIFE? ":"? <"loop" {block} | "while" cond {block} | "for" pat "in" ns {block} | {block}> | "if" cond {block} <"else" <{block} | blocky>>? | "match" ns {inner* arms} | <"unsafe" | "async" "move"? | "const"> {block}
cond : cpart <"&&" cpart>*
cpart : "let" pat "=" ns | ns
arms : <arm>* last?
arm : attr* pat <"if" cond>? "=>" <e "," | blocky ","?>
last : attr* pat <"if" cond>? "=>" e
e : bin <<".." | "..="> bin?>? | <".." | "..="> bin? | jump | closure
jump : "return" e? | "break" LIFE? e? | "continue" LIFE?
closure : <"static" | "async" | "move">* <"|" <cparam <"," cparam>* ","?>? "|" | "||"> <ret {block} | e>
cparam : pat1 <":" type>?
bin : un <bop un>* 
bop : OP | ASG | "=" | "*" | "&" | "&&" | "+" | "-" | "<" | ">" | ">" ">" | "|" | "||" | "as_"
un : pre* post | closure | jump
pre : "-" | "!" | "*" | <"&" | "&&"> <"mut" | "raw" "const" | "raw" "mut">?
post : prim suf*
suf : "?" | "." ID <"::" gargs>? (args)? | "." NUM | "." "await" | (args) | [e] | "as" type
prim : lit | epath | epath {fexprs} | epath "!" <(tokens) | [tokens] | {tokens}> | (<e <"," e>* ","?>?) | [items] | [e ";" e] | blocky
epath : <"::">? eseg <"::" eseg>* | "<" type <"as" tpath>? ">" <"::" eseg>+
eseg : seg <"::" gargs>?
fexprs : <fexpr <"," fexpr>* ","?>? | ".." e
fexpr : attr* <ID | <ID | NUM> ":" e | ".." e?>
args : items
items : <e <"," e>* ","?>?
ns : nbin <<".." | "..="> nbin?>?
nbin : nun <bop nun>*
nun : pre* npost | closure
npost : nprim suf*
nprim : lit | epath | epath "!" <(tokens) | [tokens]> | (<e <"," e>* ","?>?) | [items] | [e ";" e] | blocky
"""

TS = """
%list file N ";" "{"
%list stmts N ";" "{"
%list members N ";" "{"
%list items ","
file : stmts
stmts : stmt*
end : N | ";"
stmt : {stmts} end? | end | decl | import | export | vars end | es end | "if" (e) stmt <"else" stmt>? | "while" (e) stmt | "do" stmt "while" (e) end? | "for" "await"? (<vars | e>? ";" e? ";" e?) stmt | "for" "await"? (<<VAR | "let"> target | post> <"of" | "in"> e) stmt
  | "return" e? end | "throw" e end | "break" id? end | "continue" id? end | "debugger" end | "try" {stmts} <"catch" <(target <":" type>?)>? {stmts}>? <"finally" {stmts}>? end? | "switch" (e) {cases} end? | id ":" stmt | deco stmt
decl : fun end? | class end? | "interface" id tparams? <"extends" types>? {tmembers} end? | "type" id tparams? "=" type end | "const"? "enum" id {enums} end? | <"namespace" | "module"> <name | STR> {stmts} end? | "declare" <decl | vars end | "global" {stmts} end?> | "abstract" class end?
deco : "@" name (args)? N?
name : id <"." pname>*
vars : <VAR | "let"> var <"," var>*
var : target "!"? <":" type>? <"=" asg>?
target : id | [<telem? <"," telem?>*>] | {<tprop <"," tprop>* ","?>? N?}
telem : "..."? target <"=" asg>?
tprop : id <"=" asg>? | prop ":" target <"=" asg>? | "..." id
prop : pname | STR | NUM | [asg] | "#" pname
id : ID | CTX
pname : ID | CTX | VAR | "let" | "if" | "else" | "for" | "while" | "do" | "return" | "throw" | "break" | "continue" | "try" | "catch" | "finally" | "switch" | "case" | "default" | "class" | "extends" | "function" | "new" | "in" | "instanceof" | "typeof" | "void" | "delete" | "this" | "super" | "null" | "true" | "false" | "import" | "export" | "enum" | "debugger" | "with"
import : "import" STR attrs? end | "import" "type"? <id | <id ",">? <{specs} | "*" "as" id>> "from" STR attrs? end | "import" id "=" <name | "require" (STR)> end
attrs : <"with" | "assert"> {items}
specs : <spec <"," spec>* ","?>? N?
spec : "type"? <pname | STR> <"as" <pname | STR>>?
export : "export" "default" <fun end? | class end? | "abstract" class end? | "interface" id tparams? {tmembers} end? | asg end> | "export" "type"? {specs} <"from" STR attrs?>? end | "export" "*" <"as" pname>? "from" STR end | "export" <decl | vars end | deco class> | "export" "=" e end | "export" "as" "namespace" id end
fun : "async"? "function" "*"? id? tparams? (params) <":" rtype>? <{stmts} | end>
params : <param <"," param>* ","?>?
param : deco* access* "..."? <target | "this"> "?"? <":" type>? <"=" asg>?
access : "public" | "private" | "protected" | "readonly" | "override"
class : "class" id? tparams? <"extends" post>? <"implements" types>? {members}
members : member*
member : end | deco* mmod* prop <"?" | "!">? <":" type>? <"=" asg>? end | deco* mmod* <"get" | "set" | "async">? "*"? prop "?"? tparams? (params) <":" rtype>? <{stmts} end? | end> | "static" {stmts} end? | deco* mmod* [id ":" type] ":" type end
mmod : access | "static" | "abstract" | "declare" | "async" | "accessor"
enums : <enum <"," enum>* ","?>? N?
enum : prop <"=" asg>?
tparams : "<" <tparam <"," tparam>* ","?>? ">"
tparam : <"const" | "in" | "out">* id <"extends" type>? <"=" type>?
types : type <"," type>*
rtype : type | "asserts"? <id | "this"> <"is" type>? 
type : ftype | ctype
ftype : <"abstract">? "new"? tparams? (params) "=>" rtype
ctype : utype <"extends" utype "?" type ":" type>?
utype : "|"? itype <"|" <itype | ftype>>*
itype : "&"? otype <"&" otype>*
otype : <"keyof" | "unique" | "readonly">* ptype | "infer" id <"extends" type>?
ptype : atype <[type?]>*
atype : <name | "void" | "null" | "this" | "true" | "false"> targs? | STR | "-"? NUM | (type) | [<ttup <"," ttup>* ","?>?] | {tmembers} | "typeof" <name | "import" (STR) <"." name>?> targs? | "import" (STR) <"." name>? targs?
ttup : "..."? <id "?"? ":">? type "?"?
targs : "<" type <"," type>* ">"
tmembers : <tmember tend+>* tmember?
tend : end | ","
tmember : <"readonly" | "get" | "set" | "-" | "+">* prop "?"? <tparams? (params)>? <":" rtype>? | "new"? tparams? (params) <":" rtype>? | <"-" | "+">? "readonly"? [id ":" type] <<"-" | "+">? "?">? ":" type | <"-" | "+">? "readonly"? [id "in" type <"as" type>?] <<"-" | "+">? "?">? <":" type>?
cases : case*
case : <"case" e | "default"> ":" N? stmts
e : asg <"," asg>*
es : <terns | arrow | "yield" "*"? asg?> <"," asg>*
terns : bins <"?" asg ":" asg>?
bins : <pre+ post | prims suf*> <bop <un | arrow> | <"as" | "satisfies"> <type | "const_">>*
asg : tern | arrow | "yield" "*"? asg?
arrow : "async"? <id | tparams? (params) <":" rtype>?> "=>" <asg | {stmts}>
tern : bin <"?" asg ":" asg>?
bin : un <bop <un | arrow> | <"as" | "satisfies"> <type | "const_">>*
bop : OP | ASG | "=" | "*" | "+" | "-" | "<" | ">" | ">" ">" | ">" ">" ">" | "|" | "&" | "in" | "instanceof"
un : pre* post
pre : "+" | "-" | "!" | "~~" | "++" | "--" | "typeof" | "void" | "delete" | "await" | "<" type ">"
post : prim suf*
suf : "." <pname | "#" pname> | "?." <pname | (args) | [e] | "#" pname> | [e] | (args) | STR | "!" | "++" | "--" | targs
prims : id | NUM | STR | "this" | "super" | "null" | "true" | "false" | (e) | [elems] | "new" newx | "import" (args) | "import" "." pname | "#" pname
prim : prims | {props} | "async"? "function" "*"? id? tparams? (params) <":" rtype>? {stmts} | deco* class
newx : prim <"." pname | [e] | targs>* (args)? | "." pname
elems : items | <arg? <"," arg?>*>
args : items
items : <arg <"," arg>* ","?>?
arg : "..."? asg
props : <pprop <"," pprop>* ","?>? N?
%list props ","
pprop : prop ":" asg | id <"=" asg>? | <"async" | "get" | "set">? "*"? prop tparams? (params) <":" rtype>? {stmts} | "..." asg
"""

KOTLIN = """
%list file N ";" "{"
%list script N ";" "{"
%list stmts N ";" "{"
%list members N ";" "{"
%list items ","
end : N | ";"
file : fileann* <"package" name end>? top*
script : fileann* <"package" name end>? <top | stmt>*
fileann : "@" "file" ":" <name (args)? | [tokens]> N?
top : end | "import" name <"." "*">? <"as" id>? end | decl
name : id <"." id>*
id : ID | CTX
mods : mod*
mod : "public" | "private" | "protected" | "internal" | "open" | "abstract" | "final" | "sealed" | "data" | "inner" | "override" | "lateinit" | "const" | "suspend" | "inline" | "infix" | "operator" | "tailrec" | "external" | "vararg" | "noinline" | "crossinline" | "expect" | "actual" | "annotation" | "enum" | "value" | "companion" | "reified" | "out" | "in" | ann
ann : "@" <id ":">? utype0 (args)? N?
utype0 : id <"." id>* targs?
decl : mods <class | iface | object | fun | property | alias> end?
class : "class" id tparams? <mods "constructor">? <(cparams)>? <":" supers>? where? <{cbody}>?
iface : "fun"? "interface" id tparams? <":" supers>? where? <{cbody}>?
object : "object" id? <":" supers>? <{cbody}>?
alias : "typealias" id tparams? "=" type end
supers : super <"," super>*
super : type (args)? <"by" e>?
where : "where" id ":" type <"," id ":" type>*
cparams : <cparam <"," cparam>* ","?>?
cparam : mods <"val" | "var">? id ":" type <"=" e>?
cbody : members | N? entries <";" members | N>?
entries : <entry <"," N? entry>* ","?>? 
entry : ann* id (args)? <{members}>?
members : member*
member : end | decl | "init" {stmts} end? | mods "constructor" (cparams) <":" <"this" | "super"> (args)>? <{stmts}>? end?
fun : "fun" tparams? <rtype ".">? id (params) <":" type>? where? <"=" N? e end | {stmts} | end>
rtype : type0
params : <param <"," param>* ","?>?
param : mods id ":" type <"=" e>?
property : <"val" | "var"> tparams? <<type0 ".">? id <":" type>? | (destr)> where? <"=" N? e | "by" e>? end? accs
accs : <acc end?>*
acc : mods <"get" | "set"> <(<id <":" type>?>?)>? <":" type>? <"=" e | {stmts}>?
destr : <id | "_"> <":" type>? <"," <id | "_"> <":" type>?>*
tparams : "<" tparam <"," tparam>* ","? ">"
tparam : mods id <":" type>?
type : mods "suspend"? <type0 | <type0 ".">? (ftparams) "->" type>
type0 : <utype | (type)> "?"*
utype : id targs? <"." id targs?>* <"&" type>?
ftparams : <<id ":">? type <"," <id ":">? type>* ","?>?
targs : "<" targ <"," targ>* ","? ">"
targ : <"in" | "out">? type | "*"
stmts : stmt*
stmt : end | decl | <id "@">? loop end? | e end | ann stmt | asgn end
asgn : post <"=" | ASG> N? e
loop : "for" (ann* <id <":" type>? | (destr)> "in" e) body | "while" (e) <body | ";"> | "do" body? N? "while" (e)
body : {stmts} | e | asgn
e : bin
bin : un <bop N? un | "is" type | "!is" type | <"as" | "as?"> type>*
bop : OP | "<" | ">" | "+" | "-" | "*" | "&&" | "||" | "?:" | "in" | "!in" | ".." | id
un : pre* post
pre : "+" | "-" | "!" | "++" | "--" | ann | id "@"
post : prim suf*
suf : <"." | "?." | "::"> <id targs? | "class"> | "::" id | (args) targs? | [items] | lam | "!!" | "++" | "--" | targs (args) | targs lam
lam : <id "@">? {lparams? stmts}
lparams : <lpar <"," lpar>* ","?>? "->" N?
lpar : <id | "_"> <":" type>? | (destr)
prim : id | NUM | STR | CHR | "true" | "false" | "null" | "this" atid? | "super" targs? atid? | (e) | lam | "if" (e) ibody? | "when" <(<"val" id "=">? e)>? {whens} | "try" {stmts} <"catch" (ann* id ":" type ","?) {stmts}>* <"finally" {stmts}>? | jump | "object" <":" supers>? {members} | "fun" <type0 ".">? (params) <":" type>? <"=" e | {stmts}> | "::" <id | "class"> | [items] | type0 "::" <id | "class">
atid : "@" id
ibody : <ibr? <";" | N>? "else" ibr?> | ibr
ibr : {stmts} | e | asgn
whens : <when | end>*
when : <wcond <"," N? wcond>* ","? | "else"> "->" N? <e | asgn | {stmts}> end?
wcond : e | <"in" | "!in"> e | <"is" | "!is"> type
jump : "return" atid? e? | "throw" e | "break" atid? | "continue" atid?
args : items
items : <arg <"," arg>* ","?>?
arg : ann* <id "=">? "*"? e
tokens : <ANY | (tokens) | [tokens]>*
"""

SWIFT = """
%list file N ";" "{"
%list stmts N ";" "{"
%list members N ";" "{"
%list items ","
end : N | ";"
file : stmts
stmts : stmt*
stmt : end | decl | e end | asgn end | <id ":">? loop end? | "guard" conds "else" {stmts} end? | "return" e? end | "throw" e end | <"break" | "continue"> id? end | "fallthrough" end | "defer" {stmts} end? | "do" <"throws" (type)>? {stmts} catch* end? | PP end?
asgn : e <"=" | ASG> e
catch : "catch" <pat <"," pat>* <"where" e>?>? {stmts}
loop : "for" "try"? "await"? "case"? pat <":" type>? "in" e <"where" e>? {stmts} | "while" conds {stmts} | "repeat" {stmts} "while" e
conds : cond <"," cond>*
cond : e | <"let" | "var"> pat <":" type>? <"=" e>? | "case" pat <":" type>? "=" e
id : ID | CTX
name : id <"." id>*
attr : "@" name (tokens)? N?
mods : <attr | mod>*
mod : "public" | "private" | "fileprivate" | "internal" | "open" | "package" | "static" | "class" | "final" | "override" | "mutating" | "nonmutating" | "lazy" | "weak" | "unowned" | "required" | "convenience" | "indirect" | "dynamic" | "optional" | "async" | "nonisolated" | "isolated" | "prefix" | "postfix" | "infix" | <"public" | "private" | "fileprivate" | "internal" | "unowned"> (id)
decl : mods <"import" id? name end | var end? | fun end? | init end? | "deinit" {stmts} end? | subs end? | type_ end? | "typealias" id gparams? "=" type end | "associatedtype" id <":" type>? <"=" type>? where? end | case end | "operator" opd end | "precedencegroup" id {tokens} end?>
opd : anyop <":" id>?
anyop : OP | ASG | "+" | "-" | "*" | "<" | ">" | "!" | "&" | "?"
var : <"let" | "var"> bind <"," bind>*
bind : pat <":" type>? <"=" e>? <{accs} | {stmts}>?
accs : <acc end?>+
acc : mods <"get" | "set" | "willSet" | "didSet"> <(id)>? <"async" | "throws">* <{stmts}>?
fun : "func" <id | anyop> gparams? (params) <"async" | "throws" | "rethrows">* <"->" type>? where? <{stmts}>?
init : "init" <"?" | "!">? gparams? (params) <"async" | "throws">* where? <{stmts}>?
subs : "subscript" gparams? (params) "->" type where? {accs | stmts}
type_ : <"struct" | "class" | "enum" | "protocol" | "extension" | "actor"> type0 gparams? <":" type <"," type>*>? where? {members}
where : "where" req <"," req>*
req : type <":" | OP> type
members : member*
member : end | decl | PP end?
case : "case" cs <"," cs>*
cs : id <(<<id ":">? type <"=" e>? <"," <id ":">? type>*>?)>? <"=" e>?
gparams : "<" gparam <"," gparam>* ">"
gparam : "each"? id <":" type>?
params : <param <"," param>* ","?>?
param : attr* <id | "_" | "in" | "for" | "where" | "is" | "as" | "if" | "while" | "case" | "default"> <id | "_">? ":" "inout"? type "..."? <"=" e>?
type : attr* <"inout" | "some" | "any" | "borrowing" | "consuming">* type0 <"&" type0>* <<"async" | "throws">* "->" type>?
type0 : tbase <"?" | "!" | "." <id gargs? | "Type" | "Protocol">>*
tbase : name gargs? <"." id gargs?>* | (<ttup <"," ttup>*>?) | [type <":" type>?] | "Self"
ttup : <<id | "_"> <id | "_">? ":">? type "..."?
gargs : "<" <type <"," type>*>? ">"
pat : <"let" | "var">? pat0 | <"is"> type
pat0 : "_" | e | (<<id ":">? pat <"," <id ":">? pat>*>?) | id | "." id (<<id ":">? pat <"," <id ":">? pat>*>?) | type0 "." id (<<id ":">? pat <"," <id ":">? pat>*>?) | pat0 "?" | e "as" type
e : bin
bin : un <bop un | "is" type | "as" <"?" | "!">? type | "?" e ":" e>*
bop : OP | "+" | "-" | "*" | "<" | ">" | "&" | ">" ">" | "=" 
un : <"try" <"?" | "!">? | "await" | "-" | "+" | "!" | "&" | "~~" | "..." | "..<">* post
post : prim suf*
suf : "." <id gargs? | "init" | "self" | NUM | "Type"> | (args) | [items] | {closure} | <id ":" {closure}>  | "?" | "!" | gargs | "..."
prim : id | NUM | STR | "true" | "false" | "nil" | "self" | "Self" | "super" | (args) | [items] | [<pair <"," pair>* ","?>?] | [":"] | {closure} | "." <id | "init" | "self"> | "if" conds {stmts} <"else" <{stmts} | prim>>? | "switch" e {cases} | "_" | PP (args)? | OP | "\\\\" keyp
keyp : "."? post?
pair : e ":" e
closure : <attr* capture? cpars? <"async" | "throws">* <"->" type>? "in" N?>? stmts
capture : [items]
cpars : (<cpar <"," cpar>*>?) | <id | "_"> <"," <id | "_">>*
cpar : <id | "_"> <id | "_">? <":" type>?
cases : <scase | PP end?>*
scase : attr* <"case" spat <"," N? spat>* | "default"> ":" N? stmts
spat : pat <"where" e>?
items : <arg <"," arg>* ","?>?
args : items
arg : <<id | "for" | "in" | "if" | "where" | "is" | "as" | "default" | "case" | "while" | "class" | "func" | "return" | "self" | "extension" | "protocol" | "import" | "init" | "repeat"> ":">? <e | anyop | type>
tokens : <ANY | (tokens) | [tokens] | {tokens}>*
"""

SCALA = """
%list file N ";" "{"
%list stmts N ";" "{"
%list items ","
end : N | ";"
file : <"package" name <{file} end? | end>>* top*
top : end | imp end | pkg | dfn end?
pkg : "package" "object"? name {stmts} end?
imp : <"import" | "export"> iexpr <"," iexpr>*
iexpr : name <"." <"_" | "*" | "given" | {<isel <"," isel>* ","?>? N?}>>?
isel : <id | "_" | "*" | "given" type?> <<"=>" | "as"> <id | "_">>?
name : <id | "this"> <"." <id | "type">>*
id : ID | "*" | "+" | "-" | "|" | "&" | "<" | ">" | "!" | "?" | OP | "~~" | CTX
mods : <mod | ann>*
mod : "private" | "protected" | <"private" | "protected"> [<id | "this">] | "final" | "sealed" | "abstract" | "implicit" | "lazy" | "override" | "inline" | "open" | "opaque" | "transparent" | "infix" | "case"
ann : "@" name <[types]>? (items)? N?
dfn : mods <"val" pats <":" type>? <"=" N? e>? | "var" pats <":" type>? <"=" <e | "_">>? | def | "type" id tparams? <bounds | "=" type>? | cls | "object" id <"extends" tmpl>? <{body}>? | "enum" id tparams? ctor? <"extends" tmpl>? {ebody} | "given" <id? tparams? (params)* ":">? type <"=" e | "with"? {body}> | "extension" tparams? (params) N? <def | {stmts}>>
def : "def" <id | "this"> tparams? <(params)>* <":" type>? <"=" N? e | {stmts} | >
cls : <"class" | "trait"> id tparams? mods ctor? <"extends" tmpl>? <"derives" name <"," name>*>? <{body}>?
ctor : <(params)>+
tparams : [<tparam <"," tparam>*>]
tparam : ann* <"+" | "-">? <id | "_"> tparams? bounds
bounds : <">:" type>? <"<:" type>? <"<%" type>* <":" type>*
params : <"implicit" | "using">? <param <"," param>* ","?>? | "using" types
param : mods <"val" | "var">? id <":" "=>"? type "*"?>? <"=" e>?
tmpl : type <(items)>* <<"with" | ","> type <(items)>*>*
body : self? stmts
self : N? <id | "_" | "this"> <":" type>? "=>" N?
ebody : <"case" cdef <"," cdef>* end | stmt>*
cdef : id tparams? ctor? <"extends" tmpl>?
type : ftype | itype <"match" {tcases}>?
tcases : <"case" type "=>" type end?>*
ftype : <(<"=>"? type <"," "=>"? type>*>?) | itype> <"=>" | "?=>"> type
itype : ptype <id ptype | "with" ptype>*
ptype : stype <[types] | "#" id | {stmts}>* "*"?
stype : name <"." "type">? | (<type <"," type>*>?) | "_" bounds | "?" bounds | STR | NUM | "{" 
types : <type <"," type>*>?
stmts : stmt*
stmt : end | imp end | dfn end? | e end | asg end
asg : post "=" e | post ASG e
e : <id | "_" | <"implicit">? id | (params)> <"=>" | "?=>"> N? <e | stmts> | e1
e1 : "if" (e) N? e <";" | N>? "else" N? e | "if" (e) N? e0 | "if" bin "then" N? e <N? "else" e>? | "while" (e) N? e0 | "while" bin "do" N? e0 | "for" <(enums) | {enums}> N? "yield"? N? e0 | "for" <(enums) | {enums}>? enums? <"do" | "yield"> N? e0 | "try" e <"catch" <{cases} | e>>? <"finally" e>? | "throw" e | "return" e? | "do" e "while" (e) | bin <"match" {cases}>? | bin ":" <type | ann+ | "_" "*"> | "new" tmpl? <{body}>? | asg
e0 : e | asg
enums : <N? enum <<";" | N> enum>*> end?
enum : "val"? "case"? pat <"<-" | "="> e guard* | guard
guard : "if" bin
bin : un <bop N? un>* pop?
bop : OP | id | "*" | "+" | "-" | "<" | ">" | "|" | "&" | "::"
pop : id
un : <"-" | "+" | "!" | "~~">? post | "new" tmpl <{body}>? suf* | e2
e2 : "if" (e) N? e <";" | N>? "else" N? e | "throw" e
post : prim suf*
suf : "." <id | "match" {cases} | "type"> | [types] | (args) | {lambda} | "_"
prim : id | NUM | STR | CHR | "true" | "false" | "null" | "this" | "super" <[id]>? | "_" | (<e0 <"," e0>* ","?>?) | {lambda} | "new" tmpl <{body}>? | "given"
lambda : cases | self? stmts | lparam "=>" N? stmts
lparam : <"implicit">? id <":" type>? | (params) | "_" <":" type>?
cases : N? case+
case : "case" pat <"if" e>? "=>" N? stmts
pats : pat <"," pat>*
pat : pat1 <"|" pat1>*
pat1 : <id | "_"> ":" type | <id "@">? pat2 
pat2 : pat3 <id pat3 | OP pat3 | "::" pat3>*
pat3 : "_" "*"? | "-"? NUM | STR | CHR | "true" | "false" | "null" | name <[types]>? <(<pat <"," pat>*>?)>? | (<pat <"," pat>*>?) | STR
args : "using"? items
items : <arg <"," arg>* ","?>? N?
arg : <id "=">? e <":" "_" "*">? "*"?
"""

RUBY = """
%list file N ";"
%list stmts N ";"
%list items ","
end : N | ";"
file : stmts
stmts : stmt*
stmt : end | x end
x : e mod* | "alias" aname aname | "undef" aname | BEGIN {stmts} | "return" rargs? mod* | <"break" | "next"> rargs? mod* | "redo" | "retry"
aname : fname | SYM
mod : <"if_" | "unless_" | "while_" | "until_"> e | "rescue" e
rargs : arg <"," arg>*
e : "not" e | "!" cmd | eb <<"and" | "or"> N? <e | "return" rargs? | "raise" rargs? | "next" | "break">>*
eb : asg | cmd
asg : lhs <"," lhs>* ","? <"=" | ASG> N? <rargs | cmd | "rescue_"> <"rescue" e>?
lhs : "*"? post | (lhs <"," lhs>*)
cmd : tern | post0 cargs doblock? | "yield" cargs | "super" cargs doblock? | "defined?" e
cargs : arg <"," arg>*
post0 : ID | post <"." | "&." | "::"> <ID | KWN> | "raise" | "puts" | "require"
tern : range <"?" N? tern N? ":" N? tern>?
range : bin <".." bin? | "..." bin?>? | <".." | "..."> bin
bin : un <bop N? un>*
bop : OP | "*" | "+" | "-" | "&" | "<" | ">" | "|" | "**" | "=~" | "<<" | "&&" | "||"
un : <"-" | "+" | "!" | "~~" | "&" | "defined?">* post | "not" un | lam
lam : "->" <(params) | ID>? <{stmts} | doblock>
post : prim suf*
suf : <"." | "&." | "::"> <ID | KWN | CONST | "class_" | (args)> | (args) | [items] | blk | doblock | "!" 
blk : {<"|" bparams "|" N?>? stmts}
doblock : ~"do" <"|" bparams "|">? N? bodyr~
bparams : <bparam <"," bparam>* ","?>? <";" ID <"," ID>*>?
bparam : "*"? "**"? "&"? ID <"=" tern>? | (bparams) | ID ":" tern? | LABEL tern? | "*" | "**"
prim : ID | CONST | IVAR | NUM | str | SYM | "nil" | "true" | "false" | "self" | "__FILE__" | "__method__" | (<stmts e? mod*>) | [items] | {hash} | "::" CONST | "yield" (args)? | "super" | "raise" | "puts" | "require" | block
str : STR+
hash : <pair <"," N? pair>* ","?>? N?
pair : arg0 "=>" N? arg0 | LABEL N? arg0? | STR ":" arg0 | "**" arg0
arg0 : tern | asg | lam
args : items
items : <arg <"," N? arg>* ","?>? N?
arg : "*" tern? | "**" tern? | "&" tern? | arg0 | LABEL N? arg0? | arg0 "=>" N? arg0 | STR ":" arg0 | cmd | "..."
block : ~"def" fname <(params) | params1>? <end bodyr | "=" N? x N?>~ | ~"class" cpath <"<" e>? end bodyr~ | ~"class" "<<" e end bodyr~ | ~"module" cpath end bodyr~ | ~"begin" N? bodyr~ | ~<"if" | "unless"> e <"then" | end> "then"? stmts <"elsif" e <"then" | end> "then"? stmts>* <"else" stmts>?~ | ~<"while" | "until"> e <"do_" | end> stmts~ | ~"for" lhs <"," lhs>* "in" e <"do_" | end> stmts~ | ~"case" e? end* <"when" rargs <"then" | end> stmts>+ <"else" stmts>?~ | ~"case" e end* <"in" pat <<"if_" | "unless_"> e>? <"then" | end> stmts>+ <"else" stmts>?~
pat : pat1 <"|" pat1>* <"=>" ID>? | pat <"," pat>+
pat1 : tern | {<LABEL pat? <"," LABEL pat?>*>? N?} | LABEL pat1? | [<pat <"," pat>*>?] | CONST (<pat>?) | "*" ID? | "nil"
bodyr : stmts <"rescue" <rargs? <"=>" lhs>?>? <"then" | end> stmts>* <"else" stmts>? <"ensure" stmts>?
cpath : "::"? CONST <"::" CONST>*
fname : <<"self" | ID | CONST> ".">? <ID | CONST | KWN | OP | "[]" | "[]=" | "+" | "-" | "*" | "<" | ">" | "!" | "=~" | "<<" | "&" | "|" | "~~" | "**" | [] "="?> 
params : <param <"," N? param>* ","?>? N?
params1 : param <"," param>*
param : "*" ID? | "**" ID? | "**" "nil" | "&" ID? | ID <"=" tern>? | LABEL tern? | (params) | "..."
"""

PYTHON = """
%list file N "~"
%list suite N "~"
%list items ","
%list dict ","
file : N? stmts
stmts : stmt*
suite : stmt+
stmt : simple <";" simple>* ";"? N | N | compound
block : N ~suite~ | simple <";" simple>* ";"? N
compound : deco* fun | deco* class | "if" named ":" block <"elif" named ":" block>* <"else" ":" block>? | "while" named ":" block <"else" ":" block>? | "async"? "for" targets "in" exprs ":" block <"else" ":" block>? | "try" ":" block <except+ <"else" ":" block>? <"finally" ":" block>? | "finally" ":" block> | "async"? "with" withs ":" block | "match" exprs ":" N ~case+~
except : "except" "*"? <tests <"as" ident>?>? ":" block
withs : withi <"," withi>* | (withi <"," withi>* ",") | (withi <"," withi>*)
withi : test <"as" target>?
case : "case" pats <"if" named>? ":" block
pats : pat <"," pat>* ","? 
pat : orpat <"as" ident>?
orpat : cpat <"|" cpat>*
cpat : "-"? NUM <<"+" | "-"> NUM>? | str | "None" | "True" | "False" | name | name (<parg <"," parg>* ","?>?) | (<spat <"," spat>* ","?>?) | [<spat <"," spat>* ","?>?] | {<ppair <"," ppair>* ","?>?}
spat : "*"? pat
parg : pat | ident "=" pat
ppair : <cpat> ":" pat | "**" ident
name : ident <"." ident>*
ident : ID | "match" | "case" | "type" | "_"
deco : "@" named N
fun : "async"? "def" ident tparams? (params) <"->" tests>? ":" block
class : "class" ident tparams? <(items)>? ":" block
tparams : [<tparam <"," tparam>* ","?>]
tparam : <"*" | "**">? ident <":" test>? <"=" test>?
params : <param <"," param>* ","?>?
param : <"*" | "**">? ident <":" "*"? test>? <"=" test>? | "*" | "/"
lparams : <lparam <"," lparam>* ","?>?
lparam : <"*" | "**">? ident <"=" test>? | "*" | "/"
simple : exprs | targets <"=" <yield | targets>>* "=" <yield | exprs> | target <ASG> <yield | exprs> | target ":" test <"=" <yield | exprs>>? | "pass" | "break" | "continue" | "return" exprs? | "raise" <test <"from" test>?>? | "global" names | "nonlocal" names | "del" targets | "assert" test <"," test>? | import | yield | "type" ident tparams? "=" test
names : ident <"," ident>*
import : "import" dotted <"as" ident>? <"," dotted <"as" ident>?>* | "from" <"." | "...">* dotted? "import" <"*" | imps | (imps ","?)>
dotted : ident <"." ident>*
imps : ident <"as" ident>? <"," ident <"as" ident>?>*
yield : "yield" <"from" test | exprs>?
targets : target <"," target>* ","?
target : "*"? <power0 | (<target <"," target>* ","?>?) | [<target <"," target>* ","?>?]>
power0 : atom trail* 
exprs : sexpr <"," sexpr>* ","?
sexpr : "*"? named
tests : test <"," test>*
named : <ident ":=">? test
test : or <"if" or "else" test>? | "lambda" lparams ":" test
or : not <<"and" | "or"> not>*
not : "not"* cmp
cmp : bin <cop bin>*
cop : CMP | "<" | ">" | "in" | "not" "in" | "is" | "is" "not"
bin : un <bop un>*
bop : OP | "*" | "**" | "+" | "-" | "|" | "/" | "@"
un : <"+" | "-" | "~~">* power
power : "await"? atom trail*
trail : (items) | [subs] | "." ident
subs : sub <"," sub>* ","?
sub : test? ":" test? <":" test?>? | "*"? named
atom : ident | NUM | str | "None" | "True" | "False" | "..." | (<yield | items1>?) | [items] | {dict}
str : STR+
items1 : exprs | sexpr compfor
items : <arg <"," arg>* ","?>? | named compfor
arg : <"*" | "**">? named | ident "=" test | named compfor
compfor : "async"? "for" targets "in" or compiter*
compiter : "async"? "for" targets "in" or | "if" nocond
nocond : <ident ":=">? or | "lambda" lparams ":" nocond
dict : <ditem <"," ditem>* ","?>? | test ":" test compfor | sexpr compfor
ditem : test ":" test | "**" bin | sexpr
"""

RFL = """
%list file (
file : form*
form : ATOM | NUM | STR | "'" form | (form*) | [form*] | {pair*}
pair : KEY form
"""
