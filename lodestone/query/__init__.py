"""The search language: lexer, grammar, arguments and rewrites; all on the driver, before any plan exists."""
