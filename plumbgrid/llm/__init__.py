"""Operations for preparing very large text corpora; nothing outside this subpackage imports it."""
