"""Languages by file name, and the classes of their lines."""

from __future__ import annotations

import functools
import re
from typing import NamedTuple


class Language(NamedTuple):
    name: str
    endings: str
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    quotes: tuple[str, ...] = ('"', "'")
    branches: str = r"\b(?:if|for|while|switch|case|catch)\b|&&|\|\|"


_C = {"line": ("//",), "block": (("/*", "*/"),)}
_HASH = {"line": ("#",)}
_TAGS = {"block": (("<!--", "-->"),), "quotes": (), "branches": ""}
LANGUAGES = (
    Language("Go", "go", **_C, quotes=('"', "'", "`"), branches=r"\b(?:if|for|switch|select|case)\b|&&|\|\||!=|=="),
    Language("C", "c h", **_C), Language("C++", "cc cpp cxx hpp hh hxx", **_C), Language("C#", "cs", **_C), Language("Java", "java", **_C),
    Language("JavaScript", "js jsx mjs", **_C, quotes=('"', "'", "`")), Language("TypeScript", "ts tsx", **_C, quotes=('"', "'", "`")),
    Language("Kotlin", "kt kts", **_C), Language("Scala", "scala", **_C), Language("Swift", "swift", **_C), Language("Rust", "rs", **_C, quotes=('"',)),
    Language("Dart", "dart", **_C), Language("Groovy", "groovy", **_C), Language("Objective-C", "m", **_C), Language("PHP", "php", line=("//", "#"), block=(("/*", "*/"),)),
    Language("CSS", "css", block=(("/*", "*/"),), branches=""), Language("SCSS", "scss", **_C, ), Language("Less", "less", **_C),
    Language("Python", "py pyw", **_HASH, block=(('"""', '"""'), ("'''", "'''")), branches=r"\b(?:if|elif|for|while|except|and|or)\b"),
    Language("Ruby", "rb", **_HASH, block=(("=begin", "=end"),), branches=r"\b(?:if|elsif|unless|for|while|until|when|rescue)\b|&&|\|\|"),
    Language("Perl", "pl pm", **_HASH), Language("R", "r", **_HASH), Language("Shell", "sh bash zsh", **_HASH, branches=r"\b(?:if|elif|for|while|case)\b|&&|\|\|"),
    Language("PowerShell", "ps1", **_HASH, block=(("<#", "#>"),)), Language("Elixir", "ex exs", **_HASH), Language("YAML", "yml yaml", **_HASH, branches=""),
    Language("TOML", "toml", **_HASH, branches=""), Language("INI", "ini cfg", line=(";", "#"), branches=""), Language("JSON", "json", branches=""),
    Language("HTML", "html htm", **_TAGS), Language("XML", "xml xsd", **_TAGS), Language("Vue", "vue", **_TAGS), Language("Markdown", "md markdown", branches="", quotes=()),
    Language("SQL", "sql", line=("--",), block=(("/*", "*/"),), branches=r"(?i)\b(?:case|when|and|or)\b"), Language("Lua", "lua", line=("--",), block=(("--[[", "]]"),)),
    Language("Haskell", "hs", line=("--",), block=(("{-", "-}"),)), Language("Erlang", "erl", line=("%",)), Language("TeX", "tex", line=("%",), branches=""),
    Language("Clojure", "clj cljs", line=(";",)), Language("Text", "txt", branches="", quotes=()),
)
#: Languages whose lines are told apart as those of another one.
ALIKE = {
    "C": "D:d di,Vala:vala vapi,Zig:zig,Solidity:sol,GLSL:glsl vert frag geom,HLSL:hlsl fx,Cuda:cu cuh,Metal:metal,Protocol Buffer:proto,Thrift:thrift,Objective-C++:mm,ActionScript:as,Haxe:hx,Verilog:v vh,SystemVerilog:sv svh,Apex:cls,Processing:pde,OpenCL:cl,Yacc:y,Lex:l,Stylus:styl,Gradle:gradle,Pony:pony,Chapel:chpl,FlatBuffers:fbs,QML:qml",
    "JavaScript": "CoffeeScript:,Svelte:,JSON5:json5,Flow:flow",
    "Python": "Cython:pyx pxd,Starlark:bzl star,GDScript:gd,Xonsh:xsh",
    "Ruby": "Crystal:cr,RSpec:,Slim:,Puppet:pp",
    "Shell": "Fish:fish,Awk:awk,Nix:nix,HCL:tf tfvars hcl,Tcl:tcl,Julia:jl,Nim:nim nims,Makefile:mk mak,CMake:cmake,Raku:raku p6,GraphQL:graphql gql,Properties:,Bitbake:bb,Just:,Dockerfile:dockerfile,CoffeeScript:coffee,Gnuplot:gp plt,Meson:,Jq:jq",
    "Haskell": "Elm:elm,PureScript:purs,Agda:agda,Idris:idr,Dhall:dhall",
    "SQL": "PLpgSQL:pgsql,PLSQL:pls plsql,Ada:adb ads,VHDL:vhd vhdl",
    "Clojure": "Common Lisp:lisp lsp,Emacs Lisp:el,Scheme:scm ss,Racket:rkt,Assembly:asm",
    "Erlang": "Prolog:pro,MATLAB:matlab,PostScript:ps eps",
    "HTML": "Svelte:svelte,XSLT:xsl xslt,SVG:svg,ASP:asp aspx,Handlebars:hbs handlebars,EJS:ejs,Twig:twig",
    "Text": "reStructuredText:rst,AsciiDoc:adoc asciidoc,Org:org,Textile:textile",
}
LANGUAGES += tuple(next(x for x in LANGUAGES if x.name == like)._replace(name=name, endings=endings) for like, more in ALIKE.items() for name, _, endings in (one.partition(":") for one in more.split(",")) if endings)
LANGUAGES += (
    Language("F#", "fs fsx fsi", line=("//",), block=(("(*", "*)"),)), Language("OCaml", "ml mli", block=(("(*", "*)"),), quotes=('"',)), Language("Pascal", "pas dpr", line=("//",), block=(("{", "}"), ("(*", "*)"))),
    Language("Fortran", "f90 f95 f03", line=("!",)), Language("Visual Basic", "vb vbs bas", line=("'",), quotes=('"',)), Language("Batchfile", "bat cmd", line=("REM", "rem", "::")),
    Language("Vim script", "vim", line=('"',), quotes=("'",)), Language("COBOL", "cob cbl", line=("*",)), Language("Smalltalk", "st", block=(('"', '"'),), quotes=("'",)),
    Language("Haml", "haml", line=("-#",)), Language("Pug", "pug jade", **_C), Language("LLVM", "ll", line=(";",)), Language("AutoHotkey", "ahk", line=(";",)), Language("Sass", "sass", **_C),
)
BY_ENDING = {e: x.name for x in LANGUAGES for e in x.endings.split()}
BY_NAME = {"Makefile": "Makefile", "Dockerfile": "Dockerfile", "Rakefile": "Ruby", "Gemfile": "Ruby", "Jenkinsfile": "Groovy"}
BY_NAME |= {"CMakeLists.txt": "CMake", "Vagrantfile": "Ruby", "Podfile": "Ruby", "Guardfile": "Ruby", "Brewfile": "Ruby", "BUILD": "Starlark", "WORKSPACE": "Starlark", "SConstruct": "Python", "meson.build": "Meson", "GNUmakefile": "Makefile", "makefile": "Makefile", "Justfile": "Just"}
#: By the program that a script's first line calls.
BY_PROGRAM = {
    **dict.fromkeys(("sh", "bash", "zsh", "dash", "ksh", "ash"), "Shell"), "fish": "Fish", "python": "Python", "pypy": "Python", "ruby": "Ruby", "perl": "Perl", "node": "JavaScript", "nodejs": "JavaScript", "deno": "TypeScript",
    "php": "PHP", "rscript": "R", "lua": "Lua", "luajit": "Lua", "groovy": "Groovy", "make": "Makefile", "pwsh": "PowerShell", "elixir": "Elixir", "escript": "Erlang", "runhaskell": "Haskell", "runghc": "Haskell",
    "awk": "Awk", "gawk": "Awk", "tclsh": "Tcl", "wish": "Tcl", "scala": "Scala", "swift": "Swift", "julia": "Julia", "racket": "Racket", "ocaml": "OCaml", "crystal": "Crystal", "nix-shell": "Nix", "raku": "Raku", "jq": "Jq", "kotlin": "Kotlin", "dart": "Dart",
}
NAMED = {x.name: x for x in LANGUAGES} | {n: Language(n, "", **_HASH) for n in ("Makefile", "Dockerfile", "Meson", "Just")}
#: languages of settings rather than of programs
SETTINGS = ("XML", "JSON", "TOML", "YAML", "INI", "SQL")
GENERATED = re.compile(r"(?:machine generated|DO NOT (?:MODIFY|EDIT)|GENERATED)")


class Counts(NamedTuple):
    loc: int
    sloc: int
    comments: int
    blanks: int
    complexity: int
    generated: bool
    classes: str  # a letter for each line: c(ode), m (comment), b(lank), - (not looked at)


@functools.cache
def _string_end(mark: str) -> re.Pattern:
    return re.compile(rf"(?:\\.|(?!{re.escape(mark)})[^\\])*{re.escape(mark)}")


@functools.lru_cache(1024)
def _marks(language: str) -> tuple[Language, re.Pattern | None, re.Pattern | None, dict[str, str]]:
    spec = NAMED.get(language, Language(language, ""))
    marks = [re.escape(m) for m in (*(b[0] for b in spec.block), *spec.line, *spec.quotes)]
    return spec, re.compile(spec.branches) if spec.branches else None, re.compile("|".join(marks)) if marks else None, dict(spec.block)


def count_lines(language: str, lines: list[str]) -> Counts:
    """Classes of lines. A line with any code is code. Counting ends with a comment
    that says that the file is generated; it is counted itself."""
    spec, branch, special, blocks = _marks(language)
    closing, classes, complexity, generated = "", [], 0, False
    for line in lines:
        rest, code, comment, plain = line.strip(), False, bool(closing), []
        if not rest and not closing:
            classes.append("b")
            continue
        while rest:
            if closing:
                _, end, rest = rest.partition(closing)
                closing = "" if end else closing
                rest = rest.lstrip()
                continue
            met = special.search(rest) if special else None
            before = rest[: met.start()] if met else rest
            code |= bool(before.strip())
            plain.append(before)
            if not met:
                break
            mark, rest = met.group(), rest[met.end() :]
            if mark in blocks and (mark != blocks[mark] or not code):
                comment, closing = True, blocks[mark]
            elif mark in spec.line:
                comment, rest = True, ""
            else:  # a string, which may hold any mark
                code = True
                end = _string_end(mark).match(rest)
                rest = rest[end.end() :] if end else ""
                plain.append(" ")
        if code:
            classes.append("c")
            complexity += len(branch.findall("".join(plain))) if branch else 0
        else:
            classes.append("m" if comment else "b")
        if classes[-1] == "m" and GENERATED.search(line):
            generated = True
            break
    letters = "".join(classes)
    return Counts(len(letters), letters.count("c"), letters.count("m"), letters.count("b"), complexity, generated, letters.ljust(len(lines), "-"))
