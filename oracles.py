"""The registered queries once more, as SQL for another engine.

Written independently of the library: distances by brute force, first and
last rows by ``row_number``, sequences and JSON by string aggregates.
"""

from __future__ import annotations

# Residue names that chains are made of.
AMINO = ("'ALA','ARG','ASN','ASP','CYS','GLN','GLU','GLY','HIS','ILE','LEU','LYS','MET','PHE','PRO','SER','THR',"
         "'TRP','TYR','VAL','SEC','PYL'")
NUCLEOTIDES = "'A','C','G','I','U','DA','DC','DG','DI','DT'"
PDB_ID = ("CASE WHEN l_partkey % 10 = 9 OR l_partkey >= 10000 THEN 'MODEL' || CAST(l_partkey AS VARCHAR) "
          "ELSE lpad(CAST(l_partkey AS VARCHAR), 4, '0') END")
CHAIN = "chr(CAST(64 + l_linenumber AS INTEGER))"

# name -> (names it builds on, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_struct": ((), f"SELECT DISTINCT l_partkey AS file_ord, {PDB_ID} AS pdb_id FROM lineitem"),
    "fx_atom": ((), f"""
        SELECT l_partkey AS file_ord, {PDB_ID} AS pdb_id, l_linenumber AS chain_pos, {CHAIN} AS chain_id,
               CAST(l_quantity AS INTEGER) AS residue_number,
               CASE WHEN l_linenumber <= 4 THEN CASE l_suppkey % 4 WHEN 0 THEN 'ALA' WHEN 1 THEN 'GLY'
                                                                 WHEN 2 THEN 'LEU' ELSE 'SER' END
                    WHEN l_linenumber = 5 THEN CASE l_suppkey % 2 WHEN 0 THEN 'VAL' ELSE 'HOH' END
                    ELSE CASE l_suppkey % 2 WHEN 0 THEN 'DA' ELSE 'DT' END END AS residue_name,
               CASE l_returnflag WHEN 'A' THEN 'CA' WHEN 'N' THEN 'N' ELSE 'C' END AS atom_name,
               CASE WHEN l_suppkey % 10 = 0 THEN 'H' ELSE 'C' END AS element,
               round(l_quantity) AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z,
               '9' || substr(CAST(year(l_shipdate) AS VARCHAR), 2, 3) AS content_id
        FROM lineitem"""),
    "heavy": (("fx_atom",), "SELECT * FROM fx_atom WHERE element NOT IN ('H', 'D')"),
    "chain": (("heavy",), f"""
        SELECT file_ord, pdb_id, chain_pos, chain_id, pdb_id || ':' || chain_id AS unique_chain_id,
               bool_and(residue_name IN ({AMINO})) AS all_amino
        FROM heavy GROUP BY file_ord, pdb_id, chain_pos, chain_id
        HAVING bool_or(residue_name IN ({AMINO}, {NUCLEOTIDES}))"""),
    "xref": ((), f"""
        SELECT map_key, uniprot_id FROM (
            SELECT lower({PDB_ID}) || '_' || {CHAIN} AS map_key,
                   CASE WHEN l_linenumber > 3 OR l_returnflag = 'R' THEN ''
                        ELSE 'P' || lpad(CAST(l_suppkey % 60 AS VARCHAR), 5, '0') END AS uniprot_id,
                   row_number() OVER (PARTITION BY l_partkey, l_linenumber
                                      ORDER BY l_orderkey DESC, l_suppkey DESC, l_returnflag DESC) AS rn
            FROM lineitem) WHERE rn = 1"""),
    "names": ((), """
        SELECT uniprot_id, protein_name FROM (
            SELECT 'P' || lpad(CAST(p_size AS VARCHAR), 5, '0') AS uniprot_id, p_name AS protein_name,
                   row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1"""),
    "header": ((), f"""
        SELECT lower({PDB_ID}) || '_' || {CHAIN}
                      || CASE WHEN l_linenumber > 6 OR p_type IN ('ECONOMY', 'PROMO') THEN 'x' ELSE '' END AS map_key, l_partkey, l_linenumber, l_orderkey, l_suppkey,
               CAST(l_quantity AS INTEGER) AS len,
               'mol:' || CASE WHEN l_linenumber <= 5 THEN 'protein' ELSE 'na' END || ' length:'
                      || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' ' || p_name AS info
        FROM lineitem JOIN part ON p_partkey = l_partkey"""),
    "seqres": (("header",), """
        SELECT map_key, info FROM (
            SELECT map_key, info, row_number() OVER (PARTITION BY map_key
                   ORDER BY l_orderkey DESC, l_suppkey DESC, len DESC) AS rn FROM header) WHERE rn = 1"""),
    "cleaned": (("seqres",), r"""
        SELECT map_key,
               trim(regexp_replace(regexp_replace(info, 'mol:\w+\s*', '', 'g'), 'length:\d+\s*', '', 'g')) AS molecule_name,
               CASE WHEN contains(info, 'mol:protein') THEN 'Protein' ELSE 'Nucleic Acid' END AS molecule_type
        FROM seqres"""),
    "annotated": (("chain", "xref", "names", "cleaned"), """
        SELECT c.*,
               CASE WHEN x.uniprot_id IS NOT NULL THEN coalesce(n.protein_name, 'Unknown Protein')
                    ELSE coalesce(h.molecule_name, 'Unknown') END AS molecule_name,
               CASE WHEN x.uniprot_id IS NOT NULL THEN 'Protein' ELSE coalesce(h.molecule_type, 'Unknown') END AS molecule_type,
               x.uniprot_id
        FROM chain c
        LEFT JOIN xref x ON x.map_key = lower(c.pdb_id) || '_' || upper(c.chain_id)
                        AND length(c.pdb_id) = 4 AND x.uniprot_id <> ''
        LEFT JOIN names n ON n.uniprot_id = x.uniprot_id
        LEFT JOIN cleaned h ON h.map_key = lower(c.pdb_id) || '_' || upper(c.chain_id)"""),
    "hits": ((), f"""
        SELECT file_ord, unique_chain_id, hit_id FROM (
            SELECT l_partkey AS file_ord, {PDB_ID} || ':' || {CHAIN} AS unique_chain_id,
                   'Q' || lpad(CAST(l_suppkey % 40 AS VARCHAR), 5, '0') AS hit_id,
                   row_number() OVER (PARTITION BY l_partkey, l_linenumber
                                      ORDER BY l_extendedprice DESC, l_suppkey % 40) AS rn
            FROM lineitem WHERE l_linenumber IN (4, 5) AND l_extendedprice >= 90000) WHERE rn = 1"""),
    "final": (("annotated", "hits"), """
        SELECT a.file_ord, a.pdb_id, a.chain_pos, a.chain_id, a.unique_chain_id,
               CASE WHEN cand AND hit_id IS NOT NULL THEN 'Matched UniProt: ' || hit_id ELSE molecule_name END AS molecule_name,
               CASE WHEN NOT cand THEN molecule_type WHEN hit_id IS NOT NULL OR all_amino THEN 'Protein'
                    ELSE 'Nucleic Acid' END AS molecule_type,
               CASE WHEN cand AND hit_id IS NOT NULL THEN hit_id ELSE uniprot_id END AS uniprot_id
        FROM (SELECT *, uniprot_id IS NULL AND molecule_type <> 'Nucleic Acid' AS cand FROM annotated) a
        LEFT JOIN hits h ON h.file_ord = a.file_ord AND h.unique_chain_id = a.unique_chain_id"""),
    "pairs": (("final",), """
        SELECT a.file_ord, a.pdb_id, a.chain_pos AS chain_pos_a, b.chain_pos AS chain_pos_b, a.unique_chain_id AS chain_a,
               b.unique_chain_id AS chain_b, a.chain_id AS id_a, b.chain_id AS id_b,
               a.uniprot_id AS uniprot_a, b.uniprot_id AS uniprot_b, a.molecule_type AS ta, b.molecule_type AS tb,
               CASE WHEN a.molecule_type = 'Unknown' OR b.molecule_type = 'Unknown' THEN NULL
                    WHEN a.molecule_type = 'Protein' AND b.molecule_type = 'Protein' THEN 'Protein-Protein'
                    WHEN a.molecule_type = 'Protein' OR b.molecule_type = 'Protein' THEN 'Protein-Nucleic Acid'
                    ELSE 'Nucleic Acid-Nucleic Acid' END AS interaction_type
        FROM final a JOIN final b ON a.file_ord = b.file_ord AND a.chain_pos < b.chain_pos"""),
    "near": (("heavy",), """
        SELECT a.file_ord, a.chain_pos AS chain_pos_a, b.chain_pos AS chain_pos_b,
               a.atom_name AS atom_a, b.atom_name AS atom_b,
               a.residue_number || ':' || a.residue_name AS residue_a, b.residue_number || ':' || b.residue_name AS residue_b,
               sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
        FROM heavy a JOIN heavy b ON a.file_ord = b.file_ord AND a.chain_pos < b.chain_pos
        WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 225"""),
    "near5": (("near", "chain"), """
        SELECT n.* FROM near n
        SEMI JOIN chain ca ON n.file_ord = ca.file_ord AND n.chain_pos_a = ca.chain_pos
        SEMI JOIN chain cb ON n.file_ord = cb.file_ord AND n.chain_pos_b = cb.chain_pos WHERE n.d <= 5"""),
    "ca_count": (("near", "pairs"), """
        SELECT n.file_ord, n.chain_pos_a, n.chain_pos_b, count(*) AS ca_count
        FROM near n JOIN pairs p USING (file_ord, chain_pos_a, chain_pos_b)
        WHERE atom_a = 'CA' AND atom_b = 'CA' AND ta <> 'Nucleic Acid' AND tb <> 'Nucleic Acid'
        GROUP BY n.file_ord, n.chain_pos_a, n.chain_pos_b"""),
    "inter": (("pairs", "near5", "ca_count"), """
        SELECT p.*, n.n AS all_atoms_count
        FROM pairs p
        JOIN (SELECT file_ord, chain_pos_a, chain_pos_b, count(*) AS n FROM near5 GROUP BY ALL) n
             USING (file_ord, chain_pos_a, chain_pos_b)
        LEFT JOIN ca_count c USING (file_ord, chain_pos_a, chain_pos_b)
        WHERE interaction_type IS NOT NULL
          AND (ta = 'Nucleic Acid' OR tb = 'Nucleic Acid' OR c.ca_count >= 10)"""),
    "inter_1": (("pairs", "near5", "ca_count"), """
        SELECT p.*, n.n AS all_atoms_count
        FROM pairs p
        JOIN (SELECT file_ord, chain_pos_a, chain_pos_b, count(*) AS n FROM near5 GROUP BY ALL) n
             USING (file_ord, chain_pos_a, chain_pos_b)
        LEFT JOIN ca_count c USING (file_ord, chain_pos_a, chain_pos_b)
        WHERE interaction_type IS NOT NULL
          AND (ta = 'Nucleic Acid' OR tb = 'Nucleic Acid' OR c.ca_count >= 1)"""),
    "cedges": (("inter",), """
        SELECT 'Chain_Interaction_Network_' || split_part(chain_a, ':', 1) AS network, chain_a AS source,
               chain_b AS target, all_atoms_count, 'interacts_with' AS interaction FROM inter"""),
    "cnodes": (("final", "cedges"), """
        SELECT 'Chain_Interaction_Network_' || pdb_id AS network, unique_chain_id AS id, unique_chain_id AS name,
               molecule_name AS tooltip, molecule_type AS color_group, molecule_name
        FROM final WHERE 'Chain_Interaction_Network_' || pdb_id IN (SELECT network FROM cedges)"""),
    "c2p": (("final",), "SELECT unique_chain_id, uniprot_id FROM final WHERE uniprot_id IS NOT NULL"),
    "summary": (("final",), """
        SELECT uniprot_id, CASE WHEN count(DISTINCT pdb_id) > 1 THEN 'Multi' ELSE any_value(pdb_id) END AS color_group,
               arg_max(molecule_name, file_ord * 100 + chain_pos) AS molecule_name
        FROM final WHERE uniprot_id IS NOT NULL GROUP BY uniprot_id"""),
    "lifted": (("inter_1",), """
        SELECT *, CASE WHEN uniprot_a < uniprot_b THEN uniprot_a || '|' || uniprot_b
                       ELSE uniprot_b || '|' || uniprot_a END AS pair
        FROM inter_1 WHERE uniprot_a IS NOT NULL AND uniprot_b IS NOT NULL AND uniprot_a <> uniprot_b"""),
    "pp": (("lifted",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdb_id, pair
               ORDER BY file_ord, chain_pos_a, chain_pos_b) AS rn,
               sum(all_atoms_count) OVER (PARTITION BY pdb_id, pair) AS total FROM lifted) WHERE rn = 1"""),
    "pc": (("lifted",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair
               ORDER BY file_ord, chain_pos_a, chain_pos_b) AS rn FROM lifted) WHERE rn = 1"""),
    "pedges": (("pp",), """
        SELECT 'Protein_Network_' || pdb_id AS network, uniprot_a AS source, uniprot_b AS target, all_atoms_count,
               'interacts_with' AS interaction FROM pp"""),
    "pcedges": (("pc",), """
        SELECT 'Combined_Protein_Network' AS network, uniprot_a AS source, uniprot_b AS target, all_atoms_count,
               'interacts_with' AS interaction FROM pc"""),
}
# The search: letters by rule, seeds of five letters on one diagonal, best stretch by running sums.
_LETTERS = "'ACDEFGHIKLMNPQRSTVWY'"
_LIKE = " ".join(f"WHEN '{c}' THEN {i}" for i, g in enumerate(("AGPST", "C", "DENQ", "FWY", "HKR", "ILMV")) for c in g)
_RUN = "ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag"
_CTES |= {
    "sq": ((), f"""
        SELECT l_partkey AS file_ord, string_agg(substr({_LETTERS}, CAST(l_suppkey % 20 + 1 AS INTEGER), 1), '' {_RUN}) AS s
        FROM lineitem GROUP BY l_partkey"""),
    "st": ((), f"""
        SELECT 'Q' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS id,
               string_agg(substr({_LETTERS}, CAST((l_suppkey + CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END) % 20 + 1 AS INTEGER), 1), '' {_RUN}) AS s
        FROM lineitem WHERE NOT (l_linenumber = 7 AND l_returnflag = 'N') GROUP BY l_partkey"""),
    "sqk": (("sq",), "SELECT file_ord, i, substr(s, i, 5) AS k FROM (SELECT *, unnest(range(1, length(s) - 3)) AS i FROM sq)"),
    "stk": (("st",), "SELECT min(id) OVER (PARTITION BY s) AS id, i, substr(s, i, 5) AS k FROM (SELECT *, unnest(range(1, length(s) - 3)) AS i FROM st)"),
    "sdiag": (("sqk", "stk"), """
        SELECT file_ord, id, d FROM (SELECT DISTINCT file_ord, id, b.i - a.i AS d, a.i FROM sqk a JOIN stk b USING (k)
                                     WHERE len(list_distinct(string_split(k, ''))) >= 3) GROUP BY ALL HAVING count(*) >= 2"""),
    "ssum": (("sdiag", "sq", "st"), f"""
        SELECT file_ord, id, d, i, sum(CASE WHEN a = b THEN 6 WHEN CASE a {_LIKE} END = CASE b {_LIKE} END THEN 1 ELSE -2 END)
                                   OVER (PARTITION BY file_ord, id, d ORDER BY i) AS c
        FROM (SELECT file_ord, id, d, i, substr(q, i, 1) AS a, substr(t, i + d, 1) AS b
              FROM (SELECT x.*, sq.s AS q, st.s AS t, unnest(range(greatest(1, 1 - d), least(length(sq.s), length(st.s) - d) + 1)) AS i
                    FROM sdiag x JOIN sq USING (file_ord) JOIN st USING (id)))"""),
    "shit": (("ssum",), """
        SELECT file_ord, id AS hit_id, CAST(max(c - least(0, coalesce(low, 0))) AS BIGINT) AS score
        FROM (SELECT *, min(c) OVER (PARTITION BY file_ord, id, d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM ssum)
        GROUP BY file_ord, id"""),
    "shits": (("shit",), """
        SELECT file_ord, hit_id, score, CAST(row_number() OVER (PARTITION BY file_ord ORDER BY score DESC, hit_id) AS INTEGER) AS rank
        FROM shit JOIN sq USING (file_ord)
        WHERE 0.1 * length(s) * (SELECT sum(length(s)) FROM st) * exp(-0.34488853761884875 * score) <= 1e-5"""),
}
for _name in ("pedges", "pcedges"):
    _CTES[_name.replace("edges", "nodes")] = ((_name, "summary"), f"""
        SELECT e.network, e.id, e.id AS name, coalesce(s.molecule_name, e.id) AS tooltip,
               coalesce(s.color_group, 'Multi') AS color_group, coalesce(s.molecule_name, e.id) AS molecule_name, e.id AS label
        FROM (SELECT network, source AS id FROM {_name} UNION SELECT network, target FROM {_name}) e
        LEFT JOIN summary s ON s.uniprot_id = e.id""")

# The public 20-color categorical palette "tab20".
_PALETTE = ("['#1f77b4', '#aec7e8', '#ff7f0e', '#ffbb78', '#2ca02c', '#98df8a', '#d62728', '#ff9896', '#9467bd', "
            "'#c5b0d5', '#8c564b', '#c49c94', '#e377c2', '#f7b6d2', '#7f7f7f', '#c7c7c7', '#bcbd22', '#dbdb8d', "
            "'#17becf', '#9edae5']")
_COLORED = f"""
    SELECT network, color_group,
           ({_PALETTE})[CAST(CASE WHEN n = 1 THEN 0 WHEN i = n - 1 THEN 19
                                  ELSE floor(CAST(i AS DOUBLE) * (CAST(1 AS DOUBLE) / (n - 1)) * 20) END AS INTEGER) + 1] AS color
    FROM (SELECT network, color_group, row_number() OVER (PARTITION BY network ORDER BY color_group) - 1 AS i,
                 count(*) OVER (PARTITION BY network) AS n FROM groups WHERE color_group <> 'Multi')
    UNION ALL
    SELECT network, color_group, '#d62728' AS color FROM groups
    WHERE color_group = 'Multi' AND network = 'Combined_Protein_Network'"""
_CTES["groups"] = (("cnodes", "pnodes", "pcnodes"), """
    SELECT network, color_group FROM cnodes UNION SELECT network, color_group FROM pnodes
    UNION SELECT network, color_group FROM pcnodes""")


def _order(names: tuple[str, ...], done: dict[str, None]) -> dict[str, None]:
    for name in names:
        if name not in done:
            _order(_CTES[name][0], done)
            done[name] = None
    return done


def _sql(uses: str, body: str, **extra: str) -> str:
    parts = [f"{n} AS ({_CTES[n][1]})" for n in _order(tuple(uses.split()), {})]
    parts += [f"{n} AS ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


_CHAIN_COLUMNS = "file_ord, pdb_id, chain_pos, chain_id, unique_chain_id"
_ANNOTATION = f"{_CHAIN_COLUMNS}, molecule_name, molecule_type, uniprot_id"
_EDGES = "SELECT network, source, target, all_atoms_count, interaction FROM "
_NODES = "SELECT network, id, name, tooltip, color_group, molecule_name FROM "
_PROTEIN_NODES = _NODES.replace(" FROM", ", label FROM")
_ONE = "CASE residue_name WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'LEU' THEN 'L' WHEN 'SER' THEN 'S' " \
       "WHEN 'VAL' THEN 'V' ELSE 'X' END"
_SHINGLES = r"""
    SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS g
    FROM (SELECT {id} AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '') AS w FROM {table})"""


_SCAN = f"WITH fx_atom AS ({_CTES['fx_atom'][1]})" + """
    SELECT content_id, chain_id, residue_number, residue_name, {atom} AS atom_name, element, x, y, z FROM fx_atom"""


def _json_rows(rows: str, part: int) -> str:
    return f"""
        SELECT network, {part} AS part, key,
               CASE WHEN row_number() OVER (PARTITION BY network ORDER BY key) > 1 THEN ',' ELSE '' END || line AS line
        FROM ({rows})"""


def oracle_sql() -> dict[str, str]:
    return {
        "extension_filter": """
            SELECT page_id, url FROM (SELECT *, list_extract(string_split(url, '/'), -1) AS base FROM pages)
            WHERE contains(ltrim(base, '.'), '.')
              AND lower(list_extract(string_split(base, '.'), -1)) IN ('html', 'htm')""",
        "valid_id_set": _sql("header", """
            SELECT DISTINCT upper(split_part(map_key, '_', 1)) AS pdb_id FROM header
            WHERE length(split_part(map_key, '_', 1)) = 4"""),
        "resolve_id": _sql("fx_struct header", """
            SELECT s.file_ord AS source, '/structures/' || lower(s.pdb_id) || '.pdb' AS file_path,
                   CASE WHEN length(s.pdb_id) = 4 AND s.pdb_id IN (SELECT pdb_id FROM valid) THEN s.pdb_id
                        WHEN lpad(CAST(p_size AS VARCHAR), 4, '0') IN (SELECT pdb_id FROM valid)
                             THEN lpad(CAST(p_size AS VARCHAR), 4, '0')
                        ELSE s.pdb_id END AS pdb_id
            FROM fx_struct s LEFT JOIN part ON p_partkey = s.file_ord""",
            valid="SELECT DISTINCT upper(split_part(map_key, '_', 1)) AS pdb_id FROM header "
                  "WHERE length(split_part(map_key, '_', 1)) = 4"),
        "pdb_records": _sql("fx_atom", """
            SELECT file_ord AS source, chain_id, residue_number, residue_name, atom_name, element, x, y, z FROM fx_atom"""),
        "cif_records": _sql("fx_atom", """
            SELECT file_ord AS source, element, atom_name || '''' AS atom_name, residue_name, chain_id, residue_number,
                   x, y, z FROM fx_atom"""),
        "pdb_scan": _SCAN.format(atom="atom_name"),
        "cif_scan": _SCAN.format(atom="atom_name || ''''"),
        "content_ids": """
            SELECT '9' || substr(CAST(year(l_shipdate) AS VARCHAR), 2, 3) AS content_id, count(*) AS n_atoms,
                   count(DISTINCT l_linenumber) AS n_models, kind
            FROM lineitem, (VALUES ('pdb'), ('cif')) k(kind) GROUP BY ALL""",
        "rejected_files": """
            SELECT '/nowhere/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.cif' ELSE '.html' END AS file_path,
                   CASE WHEN page_id % 2 = 0 THEN 'missing, unreadable or without atoms' ELSE 'suffix' END AS reason FROM pages""",
        "xref_last_wins": _sql("xref", "SELECT map_key, uniprot_id FROM xref"),
        "protein_name_last_wins": _sql("names", "SELECT uniprot_id, protein_name FROM names"),
        "seqres_last_wins": _sql("seqres", "SELECT map_key, info FROM seqres"),
        "heavy_atoms": _sql("heavy", """
            SELECT file_ord, chain_id, residue_number, residue_name, atom_name, x, y, z FROM heavy"""),
        "valid_chains": _sql("chain", f"SELECT {_CHAIN_COLUMNS} FROM chain"),
        "nest_chain": _sql("heavy", """
            SELECT file_ord, chain_id, CAST(residue_number // 16 AS BIGINT) AS segment,
                   CAST(count(*) AS INTEGER) AS n_residues,
                   string_agg(residue_number || ':' || residue_name || '[' || atoms || ']', ';'
                              ORDER BY residue_number, residue_name) AS nested
            FROM (SELECT file_ord, chain_id, residue_number, residue_name,
                         string_agg(atom_name, ',' ORDER BY atom_name) AS atoms
                  FROM heavy GROUP BY ALL) GROUP BY file_ord, chain_id, residue_number // 16"""),
        "unnest_chain": _sql("heavy", """
            SELECT file_ord, chain_id, residue_number || ':' || residue_name AS residue, atom_name, x, y, z FROM heavy"""),
        "chain_sequence": _sql("heavy", f"""
            SELECT file_ord, chain_id, string_agg({_ONE}, '' ORDER BY residue_number, residue_name) AS sequence
            FROM (SELECT DISTINCT file_ord, chain_id, residue_number, residue_name FROM heavy)
            GROUP BY file_ord, chain_id"""),
        "classify_chain": _sql("heavy", f"""
            SELECT file_ord, chain_id, CASE WHEN count(*) FILTER (residue_name NOT IN ({AMINO})) = 0 THEN 'Protein'
                   ELSE 'Nucleic Acid' END AS molecule_type FROM heavy GROUP BY file_ord, chain_id"""),
        "first_occurrence": f"""
            SELECT unique_chain_id, file_ord, chain_pos FROM (
                SELECT {PDB_ID} || ':' || {CHAIN} AS unique_chain_id, l_orderkey AS file_ord, l_suppkey AS chain_pos,
                       row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey) AS rn
                FROM lineitem) WHERE rn = 1""",
        "clean_header": _sql("cleaned", "SELECT map_key, molecule_name, molecule_type FROM cleaned"),
        "annotate_chains": _sql("annotated", f"SELECT {_ANNOTATION} FROM annotated"),
        "annotate_wanted": _sql("annotated", f"SELECT {_ANNOTATION} FROM annotated"),
        "annotation_preview": _sql("annotated", """
            SELECT pdb_id, chain_id, molecule_name, molecule_type, uniprot_id FROM annotated
            WHERE file_ord = (SELECT min(file_ord) FROM annotated)"""),
        "search_candidates": _sql("annotated", f"""
            SELECT {_CHAIN_COLUMNS}, molecule_type FROM annotated
            WHERE uniprot_id IS NULL AND molecule_type <> 'Nucleic Acid'"""),
        "annotate_final": _sql("final", f"SELECT {_ANNOTATION} FROM final"),
        "best_match": _sql("", """
            SELECT item_id, hit_id, shared, score FROM (
                SELECT q.id AS item_id, t.id AS hit_id, count(*) AS shared, count(*) / any_value(q.n) AS score,
                       row_number() OVER (PARTITION BY q.id ORDER BY count(*) DESC, t.id) AS rn
                FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM q) q JOIN t ON q.g = t.g
                GROUP BY q.id, t.id HAVING count(*) / any_value(q.n) >= 0.3) WHERE rn = 1""",
            q=_SHINGLES.format(id="item_id", table="benchmark"), t=_SHINGLES.format(id="doc_id", table="documents")),
        "search_hits": _sql("shits", "SELECT file_ord, hit_id, rank, score FROM shits WHERE rank <= 8"),
        "annotate_by_search": _sql("annotated shits", f"""
            SELECT {_CHAIN_COLUMNS}, CASE WHEN cand AND hit_id IS NOT NULL THEN 'Matched UniProt: ' || hit_id ELSE molecule_name END AS molecule_name,
                   CASE WHEN NOT cand THEN molecule_type WHEN hit_id IS NOT NULL OR all_amino THEN 'Protein' ELSE 'Nucleic Acid' END AS molecule_type,
                   CASE WHEN cand AND hit_id IS NOT NULL THEN hit_id ELSE uniprot_id END AS uniprot_id
            FROM (SELECT *, uniprot_id IS NULL AND molecule_type <> 'Nucleic Acid' AS cand FROM annotated)
            LEFT JOIN (SELECT * FROM shits WHERE rank = 1) USING (file_ord)"""),
        "chain_pairs": _sql("chain", """
            SELECT a.file_ord, a.unique_chain_id AS chain_a, b.unique_chain_id AS chain_b
            FROM chain a JOIN chain b ON a.file_ord = b.file_ord AND a.chain_pos < b.chain_pos"""),
        "interaction_type": _sql("pairs", """
            SELECT file_ord, chain_a, chain_b, interaction_type FROM pairs WHERE interaction_type IS NOT NULL"""),
        "radius_pair_count": _sql("near", """
            SELECT file_ord, chain_pos_a, chain_pos_b, count(*) AS n_pairs FROM near WHERE d <= 5
            GROUP BY file_ord, chain_pos_a, chain_pos_b"""),
        "ca_contact_count": _sql("ca_count", "SELECT file_ord, chain_pos_a, chain_pos_b, ca_count FROM ca_count"),
        "all_atom_count": _sql("near5", """
            SELECT file_ord, chain_pos_a, chain_pos_b, count(*) AS all_atoms_count FROM near5 GROUP BY ALL"""),
        **{name: _sql("inter", """
            SELECT '/structures/' || lower(pdb_id) || '.pdb' AS file_path, chain_a, chain_b, all_atoms_count,
                   interaction_type FROM inter""") for name in ("chain_interactions", "chain_interactions_compat")},
        "compat_repeats": _sql("chain heavy", """
            SELECT p.file_ord, id || ':' || p.a AS chain_a, id || ':' || p.b AS chain_b, n.n AS all_atoms_count,
                   CASE WHEN amino_a AND amino_b THEN 'Protein-Protein' WHEN amino_a OR amino_b THEN 'Protein-Nucleic Acid'
                        ELSE 'Nucleic Acid-Nucleic Acid' END AS interaction_type
            FROM (SELECT x.file_ord, x.id, x.chain_id AS a, y.chain_id AS b, x.all_amino AS amino_a, y.all_amino AS amino_b
                  FROM named x JOIN named y ON x.file_ord = y.file_ord AND x.chain_pos < y.chain_pos) p
            JOIN counts n USING (id, a, b)
            WHERE NOT amino_a OR NOT amino_b OR n.ca >= 2""",
            named="SELECT *, 'R' || CAST(file_ord // 10 AS VARCHAR) AS id FROM chain",
            firsts="SELECT id, chain_id, min(file_ord) AS file_ord FROM named GROUP BY ALL",
            own="SELECT f.id, h.chain_id, h.atom_name, h.x, h.y, h.z FROM firsts f JOIN heavy h ON h.file_ord = f.file_ord AND h.chain_id = f.chain_id",
            counts="""
                SELECT id, s.chain_id AS a, t.chain_id AS b, count(*) FILTER (d <= 25) AS n,
                       count(*) FILTER (s.atom_name = 'CA' AND t.atom_name = 'CA') AS ca
                FROM (SELECT s, t, s.id AS id, (s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) + (s.z-t.z)*(s.z-t.z) AS d
                      FROM own s JOIN own t ON s.id = t.id AND s.chain_id < t.chain_id) WHERE d <= 225 GROUP BY ALL HAVING count(*) FILTER (d <= 25) > 0"""),
        "prefix_join": _sql("inter fx_struct", """
            SELECT s.pdb_id AS structure_id, chain_a, chain_b, all_atoms_count
            FROM fx_struct s JOIN inter i ON starts_with(i.chain_a, s.pdb_id)"""),
        **dict.fromkeys(("atom_contacts", "selected_contacts"), _sql("inter near5", """
            SELECT i.pdb_id AS "PDB_ID", i.id_a AS "Chain_A", n.residue_a AS "Residue_A", n.atom_a AS "Atom_A",
                   i.id_b AS "Chain_B", n.residue_b AS "Residue_B", n.atom_b AS "Atom_B", round(n.d, 2) AS "Distance",
                   i.uniprot_a AS "UniProt_A", i.uniprot_b AS "UniProt_B", i.interaction_type AS "Interaction_Type"
            FROM inter i JOIN near5 n USING (file_ord, chain_pos_a, chain_pos_b)""")),
        "chain_edges": _sql("cedges", _EDGES + "cedges"),
        "chain_nodes": _sql("cnodes", _NODES + "cnodes"),
        "combined_chain_network": _sql("inter", """
            SELECT 'Combined_Network' AS network, 'node' AS kind, unique_chain_id AS id, molecule_name AS tooltip,
                   molecule_type AS color_group, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS all_atoms_count
            FROM final WHERE EXISTS (SELECT 1 FROM inter)
            UNION ALL
            SELECT 'Combined_Network', 'edge', chain_a, NULL, NULL, chain_b, all_atoms_count FROM inter"""),
        "edge_endpoints": _sql("cedges", """
            SELECT network, id, id AS name, 'Unknown' AS tooltip
            FROM (SELECT network, source AS id FROM cedges UNION SELECT network, target FROM cedges)"""),
        "nonempty_networks": _sql("cnodes", "SELECT network, count(*) AS n_nodes FROM cnodes GROUP BY network"),
        "chain_to_protein": _sql("c2p", "SELECT unique_chain_id, uniprot_id FROM c2p"),
        "protein_color_group": _sql("summary", "SELECT uniprot_id, color_group FROM summary"),
        "structures_per_protein": _sql("final", """
            SELECT DISTINCT uniprot_id, pdb_id FROM final WHERE uniprot_id IS NOT NULL"""),
        "protein_edges": _sql("pedges", _EDGES + "pedges"),
        "crowded_protein_edges": _sql("", """
            SELECT 'Protein_Network_S' || g AS network, ua AS source, ub AS target, n AS all_atoms_count, 'interacts_with' AS interaction
            FROM (SELECT c.*, a.u AS ua, b.u AS ub, row_number() OVER (PARTITION BY c.g, least(a.u, b.u), greatest(a.u, b.u) ORDER BY c.ca, c.cb) AS rn
                  FROM counts c JOIN chains a ON a.g = c.g AND a.c = c.ca JOIN chains b ON b.g = c.g AND b.c = c.cb
                  WHERE a.u <> b.u AND (NOT a.amino OR NOT b.amino OR c.near_ca >= 10)) WHERE rn = 1""",
            points="""
                SELECT l_suppkey AS g, l_linenumber AS c, l_returnflag = 'A' AS is_ca, round(l_quantity) AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z,
                       l_linenumber <= 4 OR (l_linenumber = 5 AND l_suppkey % 2 = 0) AS amino, l_linenumber <> 5 OR l_suppkey % 2 = 0 AS polymer
                FROM lineitem WHERE l_suppkey % 10 <> 0""",
            chains="""
                SELECT g, c, bool_and(amino) AS amino, CASE WHEN c <= 6 THEN 'P' || lpad(CAST((g + 3 * c) % 20 AS VARCHAR), 5, '0') END AS u
                FROM points GROUP BY g, c HAVING bool_or(polymer)""",
            counts="""
                SELECT g, ca, cb, count(*) FILTER (d <= 25) AS n, count(*) FILTER (both_ca) AS near_ca
                FROM (SELECT a.g, a.c AS ca, b.c AS cb, a.is_ca AND b.is_ca AS both_ca, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d
                      FROM points a JOIN points b ON a.g = b.g AND a.c < b.c) WHERE d <= 225 GROUP BY ALL HAVING count(*) FILTER (d <= 25) > 0"""),
        "protein_edges_sum": _sql("pp", """
            SELECT 'Protein_Network_' || pdb_id AS network, uniprot_a AS source, uniprot_b AS target,
                   CAST(total AS BIGINT) AS all_atoms_count, 'interacts_with' AS interaction FROM pp"""),
        "protein_nodes": _sql("pnodes", _PROTEIN_NODES + "pnodes"),
        "combined_protein_network": _sql("pcedges", _EDGES + "pcedges"),
        "combined_protein_network_parallel": _sql("pedges", """
            SELECT 'Combined_Protein_Network' AS network, source, target, all_atoms_count, interaction FROM pedges"""),
        "combined_protein_nodes": _sql("pcnodes", _PROTEIN_NODES + "pcnodes"),
        "color_assignment": _sql("groups", _COLORED),
        "structure_colors": _sql("fx_struct", _COLORED, groups="""
            SELECT 'Combined_Protein_Network' AS network, pdb_id AS color_group FROM fx_struct"""),
        "style_name": _sql("cedges pedges pcedges", """
            SELECT network, CASE WHEN contains(network, 'Chain') THEN 'structnet_Chain_Style'
                                 WHEN contains(network, 'Combined_Protein') THEN 'structnet_Protein_Combined_Style'
                                 ELSE 'structnet_Protein_Style' END AS style_name
            FROM (SELECT network FROM cedges UNION SELECT network FROM pedges UNION SELECT network FROM pcedges)"""),
        "graph_json": _sql("cnodes cedges", f"""
            SELECT DISTINCT network, 0 AS part, '' AS key,
                   '{{"data":{{"name":"' || network || '"}},"elements":{{"nodes":[' AS line FROM cedges
            UNION ALL {_json_rows('''SELECT network, id AS key, '{"data":{"id":"' || id || '","name":"' || name
                || '","tooltip":"' || tooltip || '","color_group":"' || color_group || '","molecule_name":"' || molecule_name || '"}}' AS line FROM cnodes''', 1)}
            UNION ALL SELECT DISTINCT network, 2, '', '],"edges":[' FROM cedges
            UNION ALL {_json_rows('''SELECT network, source || ' ' || target || ' ' || all_atoms_count || ' 1' AS key,
                '{"data":{"source":"' || source || '","target":"' || target || '","interaction":"interacts_with",'
                || '"all_atoms_count":' || all_atoms_count || '}}' AS line FROM cedges''', 3)}
            UNION ALL SELECT DISTINCT network, 4, '', ']}}}}' FROM cedges"""),
    }
