"""Paths that hold no written source: endings, names and parts.

As an alternation they are an unanchored expression, so a part may lie anywhere in a path.
"""

from __future__ import annotations

import re

#: file extensions
EXTENSIONS = """
    p12 pkcs12 woff2 bz2 mp3 mp4 flake8 Z a la fla cab pdb ipdb deb lib dylib tlb icc gemspec doc arc coveragerc babelrc npmrc orc bowerrc
    jshintrc pylintrc jsbeautifyrc asc pyc psd example vscodeignore npmignore prettierignore dockerignore eslintignore sqlite xcf ldf mdf ndf
    sdf tiff woff gif tif elf wmf otf rtf ttf swf jpeg ogg editorconfig flowconfig nupkg plg png log jpg mpg svg pch sketch ai midi avi dbproj
    vbproj llblgenproj csproj fsproj bak dll iml docm pem dotm bin sln bson o ico so mailmap webp zip bzip gzip bmp app ar jar tar ipr jxr
    settings xls icns ps eps class iws project pydevproject dot eot ppt out flv mov docx pfx crx xlsx pptx 7z gz lz
""".split()
#: a path ends with one of these
ENDINGS = """
    Screengrabfile Gemfile Jenkinsfile Gruntfile tox.ini glide.lock Gopkg.lock yarn.lock glide.yaml Gopkg.toml Cargo.toml .shippable.yml
    circle.yml .drone.yml .codeclimate.yml .gitlab-ci.yml appveyor.yml .travis.yml .codecov.yml .cmake.in Makefile.in .h.in lerna.json
    package.json jsconfig.json tsconfig.json .angular-cli.json package-lock.json .js.map .css.map .babelrc.js gulpfile.js babel.config.js
    mocha.opts robots.txt CMakeLists.txt
""".split()
#: a path has one of these anywhere
PARTS = """
    .vscode/ vendor/ NOTICE README LICENSE ISSUE_TEMPLATE CONTRIBUTING COPYING CHANGELOG VERSION DCO CHANGES MAINTAINERS AUTHORS CODE_OF_CONDUCT
    __pycache__ .github proguard vendor/cache vendor/bundle .circleci .webpack node_modules Godeps .ipynb_checkpoints
""".split()
#: expressions
EXPRESSIONS = r"""
    tslint\.(yaml|json)$ \.eslintrc(\.js|\.json)?$ (^|/)go\.mod$ ^build\.gradle$ ^fastlane/Appfile$ ^fastlane/Fastfile$ \.[P]pdf$ (^|/)go\.sum$
    ^gradle\.properties$ [-\.]min\.js$ [-\.]min\.css$ dexguard-project-(debug|release)\.txt$ ^dexguard/
""".split()


def exclusion_pattern() -> str:
    """One expression for Java and RE2 alike."""
    ends = "|".join(re.escape(x).replace(r"\-", "-") for x in ENDINGS)
    parts = "|".join(re.escape(x).replace(r"\-", "-") for x in PARTS)
    return rf"\.(?:{'|'.join(EXTENSIONS)})$|(?:{ends})$|{parts}|{'|'.join(EXPRESSIONS)}"
