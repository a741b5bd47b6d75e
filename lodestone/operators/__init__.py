"""Operations on catalogs."""
