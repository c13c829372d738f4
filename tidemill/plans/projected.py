"""Rules whose tables the projection of documents and conversations has; the others are run by tests over the small corpus."""

PROJECTED: tuple[str, ...] = (
    "best_plate", "build_edges", "citation_backfill", "citation_records", "component_priority", "cross_refs",
    "current_editions", "dedup_best", "dedup_edges", "describes_pairs", "fetch_drawings", "fetch_named",
    "figure_backfill", "figure_probe", "filled_steps", "final_boost", "gate_checks", "identifier_probe",
    "lexical_by_kind", "lexical_path", "list_siblings", "named_exact", "negation_demote", "numeric_conflicts",
    "page_to_section", "panel_hop", "phrase_probe_titles", "pin_pairs", "placed_elements", "plate_pages",
    "query_features", "query_log", "ranking_boosts", "related_figures", "route_query", "section_mates",
    "section_parents", "section_text", "short_citations", "step_links", "structural_search", "superseded",
    "unique_sections", "upsert_figures", "weak_titles", "xref_hop",
    "visual_path",
    # without SQL
    "ask", "diversify_passes", "single_pass",
)
