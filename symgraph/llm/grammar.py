"""Grammars of Rust and of TypeScript / JavaScript for the chart parser, in a small EBNF.

Lower-case words and punctuation are terminals; names in capitals are rules; `(X)`, `[X]`
and `{X}` are whole bracket groups whose content must be X. `A / B` are alternatives,
`[[ ]]` is optional, `<< >>*` repeats. What brackets enclose is parsed apart (syntax.py),
so that each rule here sees one level only."""

from __future__ import annotations

RUST = """
Attrs = << # [TT] / # ! [TT] >>*
Vis = [[ pub [[ (TT) ]] ]]
Item = Attrs Vis Item1
Item1 = Fn / Struct / Enum / Union / Trait / Impl / Mod / Use / Const / Static / Alias / Crate / Extern
Fn = << const / async / unsafe / extern [[ str ]] >>* fn id [[ Gen ]] (Params) [[ -> Type ]] [[ Where ]] << {Block} / ; >>
Struct = struct id [[ Gen ]] << [[ Where ]] {Fields} / (TupFields) [[ Where ]] ; / ; >>
Enum = enum id [[ Gen ]] [[ Where ]] {Variants}
Union = id id [[ Gen ]] [[ Where ]] {Fields}
Trait = [[ unsafe ]] trait id [[ Gen ]] [[ : [[ Bounds ]] ]] [[ Where ]] {Items}
Impl = [[ unsafe ]] impl [[ Gen ]] [[ ! ]] Type [[ for Type ]] [[ Where ]] {Items}
Mod = mod id << ; / {Items} >>
Use = use UseTree ;
UseTree = [[ :: ]] << PathId :: >>* << {UseList} / '*' / PathId [[ as << id / _ >> ]] >>
Const = const << id / _ >> : Type [[ = Expr ]] ;
Static = static [[ mut ]] id : Type [[ = Expr ]] ;
Alias = type id [[ Gen ]] [[ : Bounds ]] [[ Where ]] [[ = Type ]] [[ Where ]] ;
Crate = extern crate << id / self >> [[ as << id / _ >> ]] ;
Extern = [[ unsafe ]] extern [[ str ]] {Items}
MacroItem = Path ! [[ id ]] << {TT} / (TT) ; / [TT] ; >>
Gen = '<' [[ GenP << , GenP >>* [[ , ]] ]] '>'
GenP = Attrs << lt [[ : [[ Bounds ]] ]] / const id : Type [[ = << num / str / {Block} / id >> ]] / id [[ : [[ Bounds ]] ]] [[ = Type ]] >>
Bounds = Bound << '+' Bound >>* [[ '+' ]]
Bound = lt / [[ '?' ]] [[ for Gen ]] Path / (Type)
Where = where [[ WhereP << , WhereP >>* [[ , ]] ]]
WhereP = lt : [[ Bounds ]] / [[ for Gen ]] Type : [[ Bounds ]]
Type = Type1 << '+' Bound >>*
Type1 = '&' [[ lt ]] [[ mut ]] Type1 / '&' Type1 / '*' << const / mut >> Type1 / [ArrT] / (TupT) / ! / impl Bounds / dyn Bounds / FnPtr / _ / '<' Type [[ as Path ]] '>' :: Path / Path / Path ! << (TT) / [TT] / {TT} >>
FnPtr = [[ for Gen ]] [[ unsafe ]] [[ extern [[ str ]] ]] fn (FnPtrP) [[ -> Type1 ]]
Path = [[ :: ]] PathSeg << :: PathSeg >>*
PathSeg = PathId [[ [[ :: ]] << GenArgs / (TupT) [[ -> Type1 ]] >> ]]
PathId = id / self / Self / super / crate
GenArgs = '<' [[ GenA << , GenA >>* [[ , ]] ]] '>'
GenA = lt / id [[ GenArgs ]] = Type / id : Bounds / Type / - num / num / str / {Block} / true / false
Stmts = << ; / # ! [TT] / Stmt >>*
Tail = Stmts [[ Attrs << Expr / MacroItem >> ]]
Stmt = Attrs << Vis Item1 / let Pat [[ : Type ]] [[ = Expr [[ else {Block} ]] ]] ; / Expr ; / BlockExpr / Path ! [[ id ]] {TT} >>
BlockExpr = [[ lt : ]] << loop {Block} / while Cond {Block} / for Pat in Expr {Block} / {Block} >> / If / match Expr {Match} / unsafe {Block} / async [[ move ]] {Block} / const {Block}
If = if Cond {Block} [[ else << If / {Block} >> ]]
Cond = CondP << '&' '&' CondP >>*
CondP = let Pat = Expr / Expr
Expr = Range [[ << = / aop / '>' '>=' >> Expr ]]
Range = << .. / ..= >> [[ Bin ]] / Bin [[ << .. / ..= >> [[ Bin ]] ]]
Bin = Un << BinOp Un >>*
BinOp = '+' / - / '*' / bop / '&' '&' / '|' '|' / '&' / '|' / '<' '<' / '>' '>' / '<' / '>'
Un = << - / '*' / ! / '&' [[ mut ]] >>* Post
Post = Prim << PostS >>*
PostS = . id [[ :: GenArgs ]] / . await / . num / '?' / (Args) / [Index] / as Type1
Prim = num / str / true / false / BlockExpr / Closure / return [[ Expr ]] / break [[ lt ]] [[ Expr ]] / continue [[ lt ]] / (Tuple) / [Array] / '<' Type [[ as Path ]] '>' :: ExprPath / ExprPath [[ {StructLit} / ! << (TT) / [TT] / {TT} >> ]] / let Pat = Un / _
ExprPath = [[ :: ]] PathId << :: << PathId / GenArgs >> >>*
Closure = [[ static ]] [[ async ]] [[ move ]] '|' [[ CloP << , CloP >>* [[ , ]] ]] '|' << -> Type1 {Block} / Expr >>
CloP = Pat1 [[ : Type ]]
Pat = [[ '|' ]] Pat1 << '|' Pat1 >>*
Pat1 = [[ ref ]] [[ mut ]] id [[ @ Pat1 ]] / _ / PatLit [[ << .. / ..= / ... >> [[ PatLit ]] ]] / << .. / ..= >> [[ PatLit ]] / PatPath [[ (TupPat) / {StructPat} / ! << (TT) / [TT] / {TT} >> ]] / (TupPat) / [TupPat] / '&' [[ mut ]] Pat1
PatLit = [[ - ]] num / str / true / false / PatPath
PatPath = [[ :: ]] PathId << :: << PathId / GenArgs >> >>*
Items = << # ! [TT] / Item / Attrs Vis MacroItem / ; >>*
Params1 = Attrs << [[ '&' [[ lt ]] ]] [[ mut ]] self [[ : Type ]] / Pat1 : Type / ... >>
TupFields1 = Attrs Vis Type
Fields1 = Attrs Vis id : Type
Variants1 = Attrs Vis id [[ (TupFields) / {Fields} ]] [[ = Expr ]]
FnPtrP1 = [[ << id / _ >> : ]] Type / ...
TupT1 = Type
ArrT = Type [[ ; Expr ]]
Args1 = Attrs Expr
Tuple1 = Attrs Expr
Index = Expr
Array = [[ Expr << , Expr >>* [[ , ]] ]] / Expr ; Expr
Array1 = Attrs Expr
StructLit1 = Attrs << << id / num >> [[ : Expr ]] / .. [[ Expr ]] >>
StructPat1 = Attrs << << id / num >> : Pat / [[ ref ]] [[ mut ]] id / .. >>
TupPat1 = Attrs << Pat / .. >>
UseList1 = UseTree / self [[ as << id / _ >> ]]
Match = << Attrs Pat [[ if Expr ]] => << BlockExpr [[ , ]] / Expr , >> >>* [[ Attrs Pat [[ if Expr ]] => Expr ]]
"""

#: Bracket groups of Rust by bracket, likeliest first. Those in LISTS are comma lists of their
#: rule with a 1; others are parsed as they are.
RUST_GROUPS = {"(": ["Args", "Params", "Tuple", "TupT", "TupPat", "TupFields", "FnPtrP", "Type"], "[": ["Array", "Index", "ArrT", "TupPat"], "{": ["Block", "StructLit", "Match", "Fields", "Items", "Variants", "UseList", "StructPat"]}
RUST_LISTS = frozenset("Params TupFields Fields Variants FnPtrP TupT Args Tuple StructLit StructPat TupPat UseList Array".split())
RUST_BLOCKS = {"Block": ("Stmts", "Tail"), "Items": ("Items", "Items"), "Match": ("Match", "Match")}

TS = """
Seg = << BStmt / SStmt ; / ; >>* [[ SStmt ]]
Blk = << BStmt / SStmt ; / ; >>*
Sub = BStmt / SStmt ; / ;
BStmt = {Block} / if (Expr) Sub [[ else Sub ]] / for [[ await ]] (ForHead) Sub / while (Expr) Sub / do Sub while (Expr) [[ ; ]] / with (Expr) Sub / switch (Expr) {Switch} / try {Block} << catch [[ (Catch) ]] {Block} [[ finally {Block} ]] / finally {Block} >> / Decl / export [[ default ]] Decl / Deco / [[ export ]] [[ declare ]] << namespace / module / global >> [[ << str / id << . id >>* >> ]] {Block} / Id : Sub
Deco = << @ id << . Name >>* [[ (Args) ]] >> << @ id << . Name >>* [[ (Args) ]] >>*
Decl = << declare / Deco / abstract >>* << Func / Class / Interface / EnumD >>
Func = [[ async ]] function [[ '*' ]] [[ Id ]] [[ TParams ]] (Params) [[ : RType ]] {Block}
Class = << abstract / Deco >>* class [[ Id ]] [[ TParams ]] [[ extends PostN [[ TArgs ]] ]] [[ implements TList ]] {Class}
Interface = interface Id [[ TParams ]] [[ extends TList ]] {TBody}
EnumD = [[ const ]] enum Id {Enum}
TList = Type << , Type >>*
SStmt = VarS / ExprS / return [[ Expr ]] / break [[ Id ]] / continue [[ Id ]] / throw Expr / debugger / IfS / Import / Export / [[ declare ]] Alias / [[ export ]] [[ declare ]] << abstract >>* [[ async ]] function Id [[ TParams ]] (Params) [[ : RType ]] / Id : SStmt
IfS = if (Expr) [[ Sub else ]] SStmt / for [[ await ]] (ForHead) SStmt / while (Expr) SStmt
VarS = [[ declare ]] << var / let / const >> Decls / [[ await ]] using Decls
Decls = Decl1 << , Decl1 >>*
Decl1 = Target [[ ! ]] [[ : Type ]] [[ = Assign ]]
Target = Id / {ObjPat} / [ArrPat]
Import = import << str / [[ type ]] << Id [[ , << {Import} / '*' as Id >> ]] / {Import} / '*' as Id >> from str >> [[ with {Object} ]] / import Id = Expr
Export = export << default Assign / [[ type ]] << {Import} [[ from str ]] / '*' [[ as Name ]] from str >> / VarS / [[ declare ]] Alias / = Expr / as namespace Id >>
Alias = type Id [[ TParams ]] = Type
Expr = Assign << , Assign >>*
Assign = Arrow / yield [[ [[ '*' ]] Assign ]] / Cond [[ << = / aop >> Assign ]]
Cond = Bin [[ '?' Assign : Assign ]]
Bin = Un << BinOp Un / as << const / Type >> / satisfies Type >>*
BinOp = '+' / - / '*' / bop / '&' / '|' / '<' / '>' '>' '>' / '>' '>' / '>' / in / instanceof
Un = << ! / ~ / '+' / - / typeof / void / delete / await / inc >>* << Post [[ inc ]] / '<' Type '>' Un >>
Post = Prim << PostS >>*
PostS = . Name / . # Name / '?.' << Name / (Args) / [Expr] / # Name >> / [Expr] / (Args) / tpl / ! / TArgs (Args)
Prim = Id / num / str / re / tpl / this / super / null / true / false / (Expr) / [Array] / {Object} / Func / Class / new << PostNew [[ TArgs ]] [[ (Args) ]] / . Name >> / jsx (Args) / import << (Args) / . Name >> / # Id
PostNew = Prim << . Name / [Expr] / ! >>*
Arrow = [[ async ]] << Id / [[ TParams ]] (Params) [[ : RType ]] >> => << {Block} / Assign >>
ExprS = AssignN << , Assign >>*
AssignN = Arrow / yield [[ [[ '*' ]] Assign ]] / CondN [[ << = / aop >> Assign ]]
CondN = BinN [[ '?' Assign : Assign ]]
BinN = UnN << BinOp Un / as << const / Type >> / satisfies Type >>*
UnN = << ! / ~ / '+' / - / typeof / void / delete / await / inc >> Un / PostN [[ inc ]] / '<' Type '>' Un
PostN = PrimN << PostS >>*
PrimN = Id / num / str / re / tpl / this / super / null / true / false / (Expr) / [Array] / new << PostNew [[ TArgs ]] [[ (Args) ]] / . Name >> / jsx (Args) / import << (Args) / . Name >> / # Id
Id = id / ctx
Name = id / ctx / kw
RType = [[ asserts ]] << Id / this >> is Type / asserts << Id / this >> / Type
Type = << [[ abstract ]] new >> [[ TParams ]] (Params) => RType / [[ TParams ]] (Params) => RType / UType [[ extends UType '?' Type : Type ]]
UType = [[ << '|' / '&' >> ]] PType << << '|' / '&' >> PType >>*
PType = << keyof / readonly / unique / infer >>* Type1 << [TIdx] >>*
Type1 = QName [[ TArgs ]] / [[ - ]] num / str / tpl / true / false / null / void / this / (Type) / [TTuple] / {TBody} / typeof << QName [[ TArgs ]] / import (Args) << . Name >>* >> / import (Args) << . Name >>* [[ TArgs ]]
QName = Id << . Name >>*
TArgs = '<' Type << , Type >>* '>'
TParams = '<' TParam << , TParam >>* [[ , ]] '>'
TParam = << const / in / out >>* Id [[ extends Type ]] [[ = Type ]]
ForHead = << << var / let / const / [[ await ]] using >> Target [[ : Type ]] / Post >> << of / in >> Expr / [[ VarS / Expr ]] ; [[ Expr ]] ; [[ Expr ]]
Catch = Target [[ : Type ]]
Switch = << case Expr : / default : / BStmt / SStmt ; / ; >>* [[ SStmt ]]
Class1 = << Member / ; >>* [[ Field ]]
Member = Deco / static {Block} / Mods << [[ '*' ]] PName [[ '?' ]] [[ TParams ]] (Params) [[ : RType ]] {Block} / PName [[ '?' ]] [[ TParams ]] (Params) [[ : RType ]] ; / Field1 ; >>
Field = Mods << Field1 / PName [[ '?' ]] [[ TParams ]] (Params) [[ : RType ]] >>
Field1 = PName [[ << '?' / ! >> ]] [[ : Type ]] [[ = Assign ]] / [IdxSig] : Type
Mods = << Deco / public / private / protected / static / readonly / abstract / override / declare / async / get / set / accessor >>*
PName = Name / str / num / [Expr] / # Name
TBody1 = [[ TMem << << ; / , >> TMem >>* [[ << ; / , >> ]] ]]
TMem = << readonly / [[ << '+' / - >> ]] readonly >>* << << get / set >>* PName [[ '?' ]] << : Type / [[ TParams ]] (Params) [[ : RType ]] >> / PName [[ '?' ]] / [[ new ]] [[ TParams ]] (Params) [[ : RType ]] / << [IdxSig] / [Mapped] >> [[ << '+' / - >> ]] [[ '?' ]] : Type >>
IdxSig = Id : Type
Mapped = Id in Type [[ as Type ]]
Enum1 = << Name / str >> [[ = Assign ]]
Import1 = [[ type ]] << Name / str >> [[ as << Name / str >> ]]
Object1 = ... Assign / << async / get / set / '*' >>* PName [[ TParams ]] (Params) [[ : RType ]] {Block} / PName : Assign / Id [[ = Assign ]]
ObjPat1 = ... Target / PName : Target [[ = Assign ]] / Id [[ = Assign ]]
ArrPat1 = [[ [[ ... ]] Target [[ = Assign ]] ]]
Array1 = [[ [[ ... ]] Assign ]]
Args1 = [[ ... ]] Assign
Params1 = << Deco / public / private / protected / readonly / override >>* [[ ... ]] << Target / this >> [[ '?' ]] [[ : Type ]] [[ = Assign ]]
TIdx = [[ Type ]]
TTuple1 = [[ ... ]] [[ Id [[ '?' ]] : ]] Type [[ '?' ]]
"""
TS_GROUPS = {"(": ["Args", "Params", "Expr", "ForHead", "Type", "Catch"], "[": ["Array", "Expr", "TIdx", "ArrPat", "TTuple", "IdxSig", "Mapped"], "{": ["Block", "Object", "Class", "TBody", "Switch", "Import", "ObjPat", "Enum"]}
TS_LISTS = frozenset("Enum Import Object ObjPat ArrPat Array Args Params TTuple".split())
#: Groups cut into segments at ends of statements: (rule of a segment that is whole, of one that
#: ends where a semicolon may be left out).
TS_BLOCKS = {"Block": ("Blk", "Seg"), "Class": ("Class1", "Class1"), "TBody": ("TBody1", "TBody1"), "Switch": ("Switch", "Switch")}
