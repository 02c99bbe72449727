"""Catalogue of document classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, full name (as prompts and answers have it), short name (as displayed).
CLASSES = [
    ("abondement", "Abondement", "Abondement"),
    ("acte_engagement", "Acte d'engagement", "Acte d'engagement"),
    ("ae_annexe", "Annexe à l'acte d'engagement", "Annexe Act. Eng."),
    ("application_revision_prix", "Application de révision du prix", "App. révision prix"),
    ("att_etrangers", "Attestation travailleurs étrangers", "Att. travailleurs étrangers"),
    ("att_fiscale", "Attestation fiscale", "Att. fiscale"),
    ("att_handicap", "Attestation handicap (AGEFIPH)", "Att. handicap"),
    ("att_honneur", "Attestation sur l'honneur", "Att. sur l'honneur"),
    ("att_resp_civile", "Attestation responsabilité civile professionnelle", "Att. RC pro"),
    ("att_sirene", "Attestation Sirene/Siret", "Att. Sirene/Siret"),
    ("att_sociale", "Attestation sociale", "Att. sociale"),
    ("avenant", "Avenant", "Avenant"),
    ("avis_boamp", "Avis BOAMP", "Avis BOAMP"),
    ("bon_de_commande", "Bon de commande", "Bon de commande"),
    ("bordereau_prix", "Bordereau de prix unitaire", "BPU"),
    ("ca_chgt_denomination", "CA de changement de dénomination", "CA chgt. Nom"),
    ("ca_chgt_ej", "CA de changement d'EJ", "CA chgt. EJ"),
    ("ca_chgt_siret", "CA de changement de SIRET", "CA chgt. SIREN / SIRET"),
    ("ca_chgt_revision_prix", "CA de changement de révision du prix", "CA chgt. Rev. prix"),
    ("ca_chgt_rib", "CA de changement de rib", "CA chgt. RIB"),
    ("ccag", "CCAG (Cahier des Clauses Administratives Générales)", "CCAG"),
    ("ccap", "CCAP (Cahier des Clauses Administratives Particulières)", "CCAP"),
    ("ccap_annexe", "CCAP annexe autre", "CCAP annexe autre"),
    ("ccap_annexe_beneficiaires", "CCAP annexe bénéficiaires", "CCAP annexe bénéficiaires"),
    ("ccc", "CCC (Cahier des Clauses Complementaires)", "CC Complementaire"),
    ("ccp_simple", "Cahier des clauses Particulières simple", "CCP"),
    ("ccp_vae", "CCP valant acte d'engagement", "CCP valant AE"),
    ("cctp", "CCTP (Cahier des Clauses Techniques Particulières)", "CCTP"),
    ("cctp_annexe", "CCTP annexe autre", "CCTP annexe autre"),
    ("cga", "CGA (Conditions générales d'achats)", "CGA"),
    ("commentaire", "Commentaire", "Commentaire"),
    ("conv_financement", "Convention de financement", "Conv. financement"),
    ("cv", "Curriculum vitae", "CV"),
    ("reconduction", "Reconduction", "Reconduction"),
    ("decomposition_prix", "Décomposition du prix", "DGPF"),
    ("delegation_pouvoir", "Délégation de pouvoir", "Délégation pouvoir"),
    ("detail_quantitatif_estimatif", "Détail quantitatif estimatif", "DQE"),
    ("devis", "Devis", "Devis"),
    ("ej_complexe", "EJ complexe", "EJ complexe"),
    ("facture", "Facture", "Facture"),
    ("fiche_achat", "Fiche d'achat ou de marché", "Fiche d'achat"),
    ("fiche_communication", "Fiche de communication ou de transmission", "Fiche communication"),
    ("fiche_engagement", "Fiche d'engagement", "Fiche d'engagement"),
    ("fiche_modificative", "Fiche modificative d'une fiche navette", "Fiche modificative"),
    ("fiche_navette", "Fiche navette", "Fiche navette"),
    ("kbis", "Extrait Kbis", "Kbis"),
    ("lettre_candidature_dc1", "Lettre de candidature DC1", "Candidature DC1"),
    ("lettre_candidature_dc2", "Lettre de candidature DC2", "Candidature DC2"),
    ("lettre_consultation", "Lettre de consultation", "Lettre consultation"),
    ("mail", "Courrier électronique divers", "Mail"),
    ("memoire_technique", "Mémoire technique", "Mémoire technique"),
    ("mise_au_point", "Formulaire de mise au point", "Mise au point"),
    ("notification", "Notification", "Notification"),
    ("ordre_service", "Ordre de service", "Ordre de service"),
    ("pv_cao", "Procès-verbal de Commission d'appel d'offre", "PV CAO"),
    ("question_reponse", "Questions/Réponses", "Q/R"),
    ("rapport_affermissement_tranche", "Rapport d'affermissement de tranche", "Rapport affermissement tranche"),
    ("rapport_analyse_offre", "Rapport d'analyse des offres ou de présentation des offres", "Rapport analyse offres"),
    ("rapport_signature", "Rapport de signature", "Rapport signature"),
    ("reglement_consultation", "Règlement de consultation", "Règlement consultation"),
    ("rib", "Relevé d'identité bancaire", "RIB"),
    ("service_fait", "Service fait", "Service fait"),
    ("sous_traitance", "Sous-traitance", "Sous-traitance"),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """key, full_name, short_name."""
    return spark.createDataFrame(CLASSES, "key string, full_name string, short_name string")


def _mapped(x: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for p in pairs for v in p]), x)


def key_of(name: Column) -> Column:
    """Key of a full name; null for others."""
    return _mapped(name, [(n, k) for k, n, _ in CLASSES])


def short_name_of(key: Column) -> Column:
    """Short name of a key; the key itself for others."""
    return F.coalesce(_mapped(key, [(k, s) for k, _, s in CLASSES]), key)
