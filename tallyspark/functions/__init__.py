from tallyspark.functions.exprs import (aes_key, blank_to_null, clean_term, decrypt, encrypt, first_truthy,
                                        join_truthy, like_contains_pattern, long_address, nonblank, nz,
                                        parse_number, short_address, utc_date)

__all__ = ["aes_key", "blank_to_null", "clean_term", "decrypt", "encrypt", "first_truthy", "join_truthy",
           "like_contains_pattern", "long_address", "nonblank", "nz", "parse_number", "short_address", "utc_date"]
