"""Network operators. Edges are ``[*by, src, dst, weight]``, rosters ``[*by, id]``; ``by`` lets one job serve many graphs."""
