"""Source code as relations: tokens, nodes, symbols, references and what follows from them."""
