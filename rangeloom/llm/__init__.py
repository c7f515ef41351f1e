"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Conventions shared by all of them:

* a word is a maximal run of characters other than ASCII white space, unless an
  operator says otherwise; texts are always processed whole;
* null texts are treated as empty unless a docstring says otherwise;
* input tables may carry further columns under any name: each operator picks
  the columns it needs and renames them before it joins anything.
"""
